"""Fill-in-middle: texts cut at two line ends, with the middle moved behind what surrounds it.

The tokenizers library's Split pre-tokenizer, which needs no training, isolates the matches of a
pattern and says where each begins and ends in code points. The number of these offsets is
a text's number of units; two ranks drawn from a digest of the document's id choose the ends of
prefix and middle among them. Only these three numbers come back from Python: texts are
sliced, put together and restored by Spark's own functions.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 1_000_000  # code points that the library sees at once
_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


@lru_cache(4)
def splitter(pattern: str):
    """The library's pre-tokenizer that isolates what ``pattern`` matches."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), behavior="isolated")


def unit_ends(text: str, pattern: str = LINES) -> array:
    """Code points before the end of each unit, and 0 before the first.

    The library needs about fifty bytes a code point of a text, so lines are looked for in slices of SLICE; a unit that a slice cuts goes on in the next.
    Another pattern sees the text as a whole.
    """
    ends, size = array("q", [0]), SLICE if pattern == LINES else max(1, len(text))
    for at in range(0, len(text), size):
        found = splitter(pattern).pre_tokenize_str(text[at : at + size])
        if at and text[at - 1] != "\n":
            ends.pop()
        ends.extend(at + end for _, (_, end) in found)
    return ends


def cut_points(text: str, one: int, other: int, pattern: str = LINES) -> tuple[int, int, int]:
    """Units of ``text``, and the code points before the end of prefix and middle."""
    ends = unit_ends(text, pattern)
    first, second = sorted((one % len(ends), other % len(ends)))
    return len(ends) - 1, ends[first], ends[second]


def _cuts(pattern: str):
    @F.arrow_udf("struct<n: bigint, first: bigint, second: bigint>")
    def cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        found = (cut_points(t.as_py() or "", a.as_py(), b.as_py(), pattern) for t, a, b in zip(texts, one, other, strict=True))  # one text at a time in Python
        return pa.array((dict(zip(("n", "first", "second"), x, strict=True)) for x in found), _CUTS)

    return cuts


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text from which ``output`` was made, read from output and form alone."""
    prefix, suffix, middle = marks
    after = lambda x, mark: F.substring(x, F.instr(x, mark) + len(mark), F.length(x))
    before = lambda x, mark: F.substring_index(x, mark, 1)
    tail = after(output, middle)
    psm = F.concat(before(after(output, prefix), suffix), tail, before(after(output, suffix), middle))
    spm = F.concat(before(after(output, prefix), middle), tail, before(after(output, suffix), prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, pattern: str = LINES, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of ``docs`` (doc_id, text).

    ``rate`` of 100 texts are cut, and ``spm`` of 100 of these have the suffix first. A text that is empty or holds one of
    ``marks`` stays plain, so that outputs can be read back; lengths are null there. ``n`` counts
    the units of any text. A null text is empty; a null doc_id draws as an empty one does.
    Rows that repeat a doc_id draw alike. Other columns are not read. An empty table gives an empty result.
    """
    if any(m[:1] in other[1:] for m in marks for other in marks) or len(set(marks)) < 3 or not all(marks):
        raise ValueError("marks must differ and hold their first character nowhere else, else outputs could not be read back")
    prefix, suffix, middle = marks
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    cut = drawn.withColumn("cut", _cuts(pattern)("text", "h1", "h2")).select("*", "cut.*")
    text, first, second = F.col("text"), F.col("first").cast("int"), F.col("second").cast("int")
    plain = (text == "") | text.contains(prefix) | text.contains(suffix) | text.contains(middle) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    parts = [F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))]
    formed = cut.select("doc_id", "n", form.alias("form"), "first", "second", "text", *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    p, m, s = (F.col(f"p{i}") for i in range(3))
    psm, spm_text = F.concat(F.lit(prefix), p, F.lit(suffix), s, F.lit(middle), m), F.concat(F.lit(suffix), s, F.lit(prefix), p, F.lit(middle), m)
    form = F.col("form")
    output = F.when(form == "psm", psm).when(form == "spm", spm_text).otherwise(F.col("text"))
    length = lambda x: F.when(form != "plain", x)
    return formed.select("doc_id", "n", "form", length(F.col("first")).alias("prefix_chars"), length(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))

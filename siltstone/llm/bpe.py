"""BPE encoding and decoding of whole texts; long texts by tree concatenation.

A text of more than ``LONG`` characters, or with a run of more than ``LEAF`` that no
white space splits, is halved until its leaves are short. Tasks encode the leaves in
parallel, and neighbours are joined level by level, each pair by a task of its own: a
window around the join is encoded again and grows until its tokens agree with
the left side's before the join and with the right side's behind it.

Why agreement suffices: a sequence of tokens is the BPE encoding of its text if, and only
if, each two neighbours in it are the encoding of theirs, for every merge looks at neighbours
alone. Left part, window and right part are encodings, and they share the tokens where they
meet, so each two neighbours of the joined sequence stand in one of the three. Normaliser
and pre-tokenizer look one character around; three tokens are asked to agree in place and
id, which leaves room for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, sliced, small_batches
from siltstone.llm.tokens import Pieces, tokenizer

LEAF = 16_384  # characters of a leaf at most; the library takes tens of milliseconds for one
LONG = 65_536  # characters from which a text goes through the tree, whatever splits it
_WINDOW = 64
_AGREE = 3
_ROWS = 64  # texts decoded at a time

Token = tuple[int, int, int]  # start, end (in characters of the text), id


def _tokens(own, text: str, at: int = 0) -> list[Token]:
    code = own.encode(text, add_special_tokens=False)
    return [(a + at, b + at, i) for (a, b), i in zip(code.offsets, code.ids, strict=True)]


def halves(length: int, leaf: int) -> list[tuple[int, int]]:
    """Leaves of the tree over so many characters, in order: a power of two, none longer than ``leaf``."""
    n = 1
    while length > n * leaf:
        n *= 2
    at = [length * i // n for i in range(n + 1)]
    return list(zip(at, at[1:], strict=False))


def joined(own, text: str, left: list[Token], right: list[Token], cut: int, start: int, end: int) -> list[Token]:
    """Tokens of text[start:end] from those of text[start:cut] and text[cut:end]."""
    width = _WINDOW
    while True:
        low, high = max(start, cut - width), min(end, cut + width)
        window = _tokens(own, text[low:high], low)
        first = last = None
        if low == start:
            first = (0, 0)
        else:
            near = {t: i for i, t in enumerate(left) if t[0] > low and t[1] <= cut}
            for j in range(len(window) - _AGREE + 1):
                i = near.get(window[j])
                if i is not None and window[j + _AGREE - 1][1] <= cut and left[i : i + _AGREE] == window[j : j + _AGREE]:
                    first = (i, j)
                    break
        if high == end:
            last = (len(right), len(window))
        else:
            near = {t: i for i, t in enumerate(right) if t[0] >= cut and t[1] < high}
            for j in range(len(window) - _AGREE, -1, -1):
                i = near.get(window[j])
                if i is not None and window[j][0] >= cut and right[i : i + _AGREE] == window[j : j + _AGREE]:
                    last = (i, j)
                    break
        if first and last and first[1] <= last[1]:
            return left[: first[0]] + window[first[1] : last[1]] + right[last[0] :]
        width *= 2


def _names(own) -> pa.Array | None:
    """Strings of all tokens where the tokenizer has no decoder: its texts are tokens joined by spaces."""
    if own.decoder is not None:
        return None
    return pa.array([own.id_to_token(i) for i in range(own.get_vocab_size(with_added_tokens=True))], pa.string())


def _texts(own, names: pa.Array | None, ids: pa.ListArray) -> pa.Array:
    """The library's text of each list of ids, special tokens included."""
    if names is None:
        return pa.array([own.decode(x.as_py(), skip_special_tokens=False) if x.is_valid else None for x in ids], pa.string())
    first, last = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
    tokens = names.take(ids.values.slice(first, last - first))
    joined = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), tokens), " ")
    return pc.if_else(ids.is_valid(), joined, None)


def _plain(path: str, names: list[str], decoded: bool):
    """Ids, and their text if wanted, of texts that need no tree: one pass of a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, spaced=False)
        words = _names(pieces.own)
        for batch in sliced(batches, len(names)):
            flat, offsets = pieces.encode(batch.column(len(names)).to_pylist())
            out = [*batch.columns[: len(names)], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*out, _texts(pieces.own, words, out[-1])] if decoded else out, [*names, "ids", "decoded"][: len(out) + decoded])

    return run


def _by_tree(long: DataFrame, path: str, leaf: int, names: list[str]) -> DataFrame:
    """Ids of the texts of ``long``, a table of files: numbers that rows get stay the same if a task runs again."""

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row, text, *own in part[["row", "text", *names]].itertuples(index=False):
                spans = halves(len(text), leaf)
                yield pd.DataFrame({"row": row, "node": range(len(spans)), "low": [a for a, _ in spans], "text": [text[a:b] for a, b in spans]}).assign(
                    **{name: pd.array([x] * len(spans), "Int64") for name, x in zip(names, own, strict=True)}
                )

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for part in batches:
            yield part.assign(tokens=[np.array(_tokens(own, t, a), np.int32).ravel() for t, a in zip(part["text"], part["low"], strict=True)])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        out = rows.iloc[:1].assign(node=rows["node"].iloc[:1] // 2)
        if len(rows) == 2:
            own, text = tokenizer(path), "".join(rows["text"])
            start, middle = rows["low"]
            left, right = ([(a - start, b - start, i) for a, b, i in np.asarray(x).reshape(-1, 3).tolist()] for x in rows["tokens"])
            both = joined(own, text, left, right, middle - start, 0, len(text))
            out = out.assign(text=[text], tokens=[(np.array(both, np.int32).reshape(-1, 3) + np.array([start, start, 0], np.int32)).ravel()])
        return out

    kind = "row long, node int, low int, text string, " + "".join(f"{name} long, " for name in names)
    nodes = long.withColumn("row", F.monotonically_increasing_id()).select("row", *names, "text").mapInPandas(leaves, kind.rstrip(", "))
    nodes = nodes.repartition("row", "node").mapInPandas(encoded, kind + "tokens array<int>")
    deepest = len(halves(long.agg(F.max(F.length("text"))).first()[0] or 0, leaf))
    for _ in range(deepest.bit_length() - 1):
        nodes = nodes.groupBy("row", F.floor(F.col("node") / 2)).applyInPandas(join, kind + "tokens array<int>")
    return nodes.select(*names, F.filter("tokens", lambda x, i: i % 3 == 2).alias("ids"))


def encode(docs: DataFrame, path: str, leaf: int = LEAF, long: int = LONG, carried: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """doc_id, ids for each row of ``docs`` (doc_id, text), as the tokenizers library gives them.

    ``path``: file of a word tokenizer that drops white space (a byte-level one
    needs its spaces; :mod:`siltstone.llm.token_counts` handles those). Null is the
    empty text; its ids are an empty list. Special strings inside texts become their
    special ids. Texts are whole, however long; rows that repeat, or have no doc_id,
    return a row each. An empty table gives an empty result; other columns are
    not read, but for the integer columns ``carried``, which are returned behind doc_id.
    With ``decoded`` the column of :func:`decode` is made in the same pass.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", *carried]
    rows = docs.select(*(F.col(x).cast("long").alias(x) for x in names), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tree = (F.length("text") > long) | ((F.length("text") > leaf) & F.col("text").rlike(rf"[^\x20\x09-\x0D]{{{leaf + 1},}}+"))
    kind = ", ".join(f"{x} long" for x in names) + ", ids array<int>" + ", decoded string" * decoded
    done = rows.where(~tree).mapInArrow(_plain(path, names, decoded), kind)
    apart = cut(rows.where(tree), "long")
    if apart.isEmpty():
        return done
    others = _by_tree(apart, path, leaf, names)
    return done.union(decode(others, path) if decoded else others)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids) with a column ``decoded``: the library's text, special tokens included.

    A tokenizer without decoder joins its tokens by spaces. Null ids give null.
    """
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        names = _names(own)
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                few = batch.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([*few.columns, _texts(own, names, few.column(kept.index("ids")))], [*kept, "decoded"])

    return encoded.select(kept).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(kept).schema) + ", decoded string")

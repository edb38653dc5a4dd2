"""Facts that an export must hold, found a second time and another way, and how an export differs from them.

The splitter here reads a field sign by sign and shares nothing with :func:`siltstone.functions.text.statements`, so a
fault in either shows as a difference of the two.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siltstone.functions.hashing import hash_parts

#: What a field may begin with, what opens and closes list marks, and signs that don't belong to a statement's ends.
LABELS = ("研究方向", "研究领域", "研究兴趣", "research interest", "research interests", "research area", "research areas", "research direction", "research directions")
OPENING, CLOSING, BULLETS = "(（[【", ")）]】.、:：", "-*•·"
EDGES = " -—–:：;；、,.，。·•"


def _label(text: str) -> str:
    """``text`` behind a label with its colon."""
    low = text.lower()
    for label in sorted(LABELS, key=len, reverse=True):
        if low.startswith(label):
            rest = text[len(label) :].lstrip()
            if rest[:1] in (":", "："):
                return rest[1:].lstrip()
    return text


def _mark(text: str) -> str:
    """``text`` behind one list mark: a bullet, or one to three digits with a closing sign."""
    at = 0
    if text[:1] and text[0] in BULLETS:
        return text[1:].lstrip()
    if text[:1] and text[0] in OPENING:
        at = 1
    digits = at
    while digits < len(text) and digits - at < 3 and text[digits].isascii() and text[digits].isdigit():
        digits += 1
    if digits > at and digits < len(text) and text[digits] in CLOSING:
        return text[digits + 1 :].lstrip()
    return text


def read_statements(field: str | None) -> list[str]:
    """Statements of a field, by a machine with three states: between statements, within one, in white space within one."""
    out, seen, now, state = [], set(), [], "between"
    for sign in f"{field or ''}\n":
        if sign in "；;、\n":
            text = _mark(_label("".join(now))).strip(EDGES)
            key = text.upper().lower()
            if any(unicodedata.category(c)[0] in "LN" for c in text) and key not in seen:
                seen.add(key)
                out.append(text)
            now, state = [], "between"
        elif sign.isspace():
            state = "space" if state != "between" else state
        else:
            if state == "space":
                now.append(" ")
            now.append(sign)
            state = "within"
    return out


@F.arrow_udf(ArrayType(StringType()))
def expected_statements(fields: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in fields:
        yield pa.array([read_statements(x.as_py()) for x in part], pa.list_(pa.string()))


def expected_facts(rows: DataFrame) -> DataFrame:
    """(partition, row_key) of the facts that ``rows`` must lead to, each once.

    ``rows``: build_id, entity_id, observation_id, university_id, research (a field's raw text), units (array of unit ids) and document_id (null without a page).
    """
    person = F.concat_ws(":", "build_id", "entity_id")
    own = rows.select("*", person.alias("_person"), expected_statements(F.col("research")).alias("_said"))
    statement = hash_parts(F.col("entity_id"), F.col("observation_id"), F.col("_s"))
    unit, document = F.concat_ws(":", "build_id", "_u"), F.concat_ws(":", "build_id", "document_id")

    def facts(df: DataFrame, *pairs: tuple[str, Column]) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(p).alias("partition"), k.cast("string").alias("row_key")) for p, k in pairs))).alias("f")).select("f.*")

    said = own.select("*", F.explode("_said").alias("_s")).withColumn("_id", statement)
    units = own.select("*", F.explode("units").alias("_u"))
    parts = [
        facts(own, ("node:Professor", F.col("entity_id")), ("node:University", F.col("university_id"))),
        facts(units, ("node:OrgUnit", F.col("_u")), ("rel:AFFILIATED_WITH", F.concat_ws("|", "_person", unit)), ("rel:PART_OF", F.concat_ws("|", unit, F.concat_ws(":", "build_id", "university_id")))),
        facts(said, ("node:ResearchStatement", F.col("_id")), ("rel:HAS_RESEARCH_STATEMENT", F.concat_ws("|", "_person", F.concat_ws(":", "build_id", "_id")))),
        facts(own.where("document_id IS NOT NULL"), ("node:SourceDocument", F.col("document_id")), ("rel:OBSERVED_IN", F.concat_ws("|", "_person", document))),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct()


def fact_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(partition, row_key, difference): facts that ``actual`` lacks (missing) or that nothing leads to (unexpected)."""
    keys = ["partition", "row_key"]
    a, b = expected.select(*keys).distinct().withColumn("_e", F.lit(True)), actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    both = a.join(b, keys, "full_outer").where("_e IS NULL OR _a IS NULL")
    return both.select(*keys, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("difference"))

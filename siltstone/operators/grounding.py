"""Checks of generated claims against their facts and sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import CONTACTS


def validate_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome of each claim (claim_id, kind, refs): status kept, uncertain or dropped, and its genuine refs.

    ``refs`` are structs (doc_path, heading_path, chunk_hash); ``sources`` has the same
    columns. A fact without refs becomes uncertain; a claim with a fabricated ref is
    dropped, but advice keeps its genuine ones; uncertain claims lose their refs.
    """
    keys = ["doc_path", "heading_path", "chunk_hash"]
    known = sources.select(*keys).distinct().withColumn("known", F.lit(True))
    refs = claims.select("claim_id", F.posexplode("refs").alias("at", "ref")).select("claim_id", "at", *[F.col(f"ref.{k}").alias(k) for k in keys])
    checked = refs.join(known, keys, "left")
    ref = F.struct("at", F.struct(*keys).alias("ref"))
    per = checked.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("known").isNull()).alias("n_fabricated"), F.array_sort(F.collect_list(F.when(F.col("known"), ref))).alias("genuine"))
    rows = claims.select("claim_id", "kind").join(per, "claim_id", "left").na.fill(0, ["n_refs", "n_fabricated"])
    status = (
        F.when((F.col("n_fabricated") > 0) & (F.col("kind") != "advice"), "dropped")
        .when((F.col("kind") == "uncertain") | ((F.col("kind") == "fact") & (F.col("n_refs") == 0)), "uncertain")
        .otherwise("kept")
    )
    kept = F.when(status == "kept", F.array_distinct(F.transform("genuine", lambda x: x["ref"])))
    return rows.select("claim_id", "kind", status.alias("status"), "n_refs", "n_fabricated", F.coalesce(kept, F.array().cast("array<struct<doc_path:string,heading_path:string,chunk_hash:string>>")).alias("refs"))


def has_contact(value: Column) -> Column:
    found = F.lit(False)
    for pattern in CONTACTS.values():
        found = found | F.coalesce(value.rlike(pattern), F.lit(False))
    return found


def trim_facts(facts: DataFrame, budget: int, terms: list[str]) -> DataFrame:
    """Facts (subject_id, ordinal, value) that fit a budget of quarter characters.

    Facts with contact details go; facts that a query term hits always stay; the
    others stay in order as long as they fit, and one that doesn't is skipped. That last is no running
    sum, so subjects stream through tasks in order, each with one number of state.
    """
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("value"), F.lit(t.lower()))
    cost = F.floor(F.length("value") / 4).cast("long")
    rows = facts.where(~has_contact(F.col("value"))).select("subject_id", "ordinal", "value", hit.alias("hit"), cost.alias("cost"))

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, left = None, 0
        for part in parts:
            keep = []
            for own, good, price in part[["subject_id", "hit", "cost"]].itertuples(index=False):
                if own != subject:
                    subject, left = own, max(budget, 0)
                fits = budget > 0 and price <= left
                if not good and fits:
                    left -= price
                keep.append(bool(good or fits))
            yield part[keep]

    return rows.repartition("subject_id").sortWithinPartitions("subject_id", "ordinal").mapInPandas(fit, rows.schema)


def evidence_status(values: Column) -> Column:
    """grounded for one distinct value, conflict for several, uncertain for none."""
    n = F.size(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))
    return F.when(n == 1, "grounded").when(n > 1, "conflict").otherwise("uncertain")

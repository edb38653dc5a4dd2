"""Quality gates, gold-set metrics, coverage and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(name: str, found: DataFrame, expected: int = 0) -> DataFrame:
    """One row (name, passed, expected, actual): whether ``found`` has the expected number of rows."""
    n = found.agg(F.count(F.lit(1)).alias("actual"))
    return n.select(F.lit(name).alias("name"), (F.col("actual") == expected).alias("passed"), F.lit(expected).cast("long").alias("expected"), "actual")


def gates(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def coverage(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(field, total, filled, ratio, passed) of each column in one pass."""
    figures = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~blank(F.col(c))).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = figures.selectExpr("total", f"stack({len(columns)}, {pairs}) as (field, filled)")
    ratio = F.round(F.coalesce(F.try_divide(F.col("filled"), F.col("total")), F.lit(0.0)), 6)
    return long.select("field", "total", "filled", ratio.alias("ratio"), (ratio >= least).alias("passed"))


def partition_metrics(expected: DataFrame, predicted: DataFrame, partition: str, key: str) -> DataFrame:
    """Precision and recall of predicted keys per partition, both sides as sets."""
    a = expected.select(partition, key).distinct().withColumn("_e", F.lit(1))
    b = predicted.select(partition, key).distinct().withColumn("_p", F.lit(1))
    both = a.join(b, [partition, key], "full_outer")
    n = both.groupBy(partition).agg(F.count("_e").alias("expected"), F.count("_p").alias("predicted"), F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("matched"))
    ratio = lambda x: F.round(F.coalesce(F.try_divide(F.col("matched"), F.col(x)), F.lit(1.0)), 6)
    return n.select(partition, "expected", "predicted", "matched", ratio("predicted").alias("precision"), ratio("expected").alias("recall"))


def pair_counts(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Merged pairs and the right ones among them, from group sizes: no pair is made.

    Of n members with sizes n_i by true person, n(n-1)/2 pairs are merged and the
    sum of n_i(n_i-1)/2 are right.
    """
    cells = df.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))
    right = cells.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("right_pairs"))
    merged = cells.groupBy(cluster).agg(F.sum("n").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("merged_pairs"))
    ratio = F.round(F.coalesce(F.try_divide(F.col("right_pairs"), F.col("merged_pairs")), F.lit(1.0)), 6)
    return merged.crossJoin(right).select("merged_pairs", "right_pairs", ratio.alias("precision"))


def reconcile(sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Keys in two or more sources whose values differ, null against a value included."""
    rows = None
    for name, df in sources.items():
        part = df.select(key, F.lit(name).alias("source"), F.col(value).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    n = rows.groupBy(key).agg(F.countDistinct("source").alias("n_sources"), (F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n_values"))
    return n.where("n_sources >= 2").select(key, "n_sources", (F.col("n_values") > 1).alias("mismatch"))


def retry_delay(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def deactivation(sources: DataFrame, least: float) -> DataFrame:
    """``sources`` (source, complete, rejected, n, previous) with eligible and reasons: whether what wasn't seen again may be switched off.

    The crawl must be complete, nothing rejected, somebody found, and at least the share ``least`` of the last trusted count.
    """
    ratio = F.try_divide(F.col("n"), F.nullif(F.col("previous"), F.lit(0)))
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce("complete", F.lit(False)), "crawler_state_incomplete_or_unavailable"), F.when(F.coalesce("rejected", F.lit(0)) != 0, "row_rejections"),
            F.when(F.coalesce("n", F.lit(0)) == 0, "zero_professors"), F.when(ratio < least, "source_count_regression"),
        )
    )
    return sources.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


#: What a curation must reach against its gold set.
CURATION_GATES = {"merge_precision": 0.995, "excluded_precision": 0.99, "lecturer_retention": 0.95}


def curation_gold(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(metric, value, passed) of a curation: pairs rightly merged, exclusions that are right, supervising lecturers that stay.

    ``gold`` (observation_id, person_key, role_status, supervising lecturer), ``predicted`` (observation_id, entity_id, role).
    Pairs are counted from group sizes, never made.
    """
    rows = gold.join(predicted, "observation_id")
    pairs = lambda keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    out = F.col("role") == "excluded"
    counts = rows.agg(F.count_if(out).alias("out"), F.count_if(out & (F.col("role_status") == "excluded")).alias("right"), F.count_if("lecturer").alias("lecturers"), F.count_if(F.col("lecturer") & ~out).alias("kept"))
    one = counts.crossJoin(pairs(["entity_id"]).withColumnRenamed("pairs", "merged")).crossJoin(pairs(["entity_id", "person_key"]).withColumnRenamed("pairs", "correct"))  # a row each
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0))), F.lit(1.0))
    values = {"merge_precision": share("correct", "merged"), "excluded_precision": share("right", "out"), "lecturer_retention": share("kept", "lecturers")}
    listed = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v.cast("double"), 6).alias("value"), (v >= CURATION_GATES[k]).alias("passed")) for k, v in values.items()])).alias("m"))
    return listed.select("m.*")

"""Relational building blocks: latest, first, survivorship, budgets, sampling, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import ordered_digest
from siltstone.functions.text import folded

Order = Sequence[Column]


def best_by(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The first row of each key in ``order``.

    By a window; for a latest value alone :func:`latest_value` aggregates before its shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_value(df: DataFrame, keys: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """``columns`` of each key's row that is greatest in ``by``; partial aggregates meet in the shuffle, so hot keys don't hurt."""
    row = F.max_by(F.struct(*columns), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def top_per_key(df: DataFrame, keys: list[str], order: Order, n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def ordered_union(df: DataFrame, keys: list[str], value: str, order: Order, separator: str = "；") -> DataFrame:
    """Union of a field's values per key: first of each in case-folded comparison, in order, joined."""
    first = best_by(df.where(F.col(value).isNotNull()).withColumn("_key", folded(F.col(value))), [*keys, "_key"], order)
    ranked = first.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(value).alias("v"))))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["v"]), separator).alias(value), F.count(F.lit(1)).alias("n_values"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in, nulls too; columns in ``keep`` keep an old value that is there."""
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    def pick(c: str) -> Column:
        fresh = F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        return (F.coalesce(f"a.{c}", f"b.{c}") if c in keep else fresh).alias(c)

    return a.join(b, on, "full_outer").select([pick(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, one a key (the least, the same at every run), behind those of ``old``."""
    rest = [c for c in old.columns if c not in keys]
    row = F.struct(*rest)
    one = new.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_row")).select(*keys, "_row.*") if rest else new.select(*keys).distinct()
    return old.unionByName(one.join(old.select(keys), keys, "left_anti").select(old.columns))


def within_budget(df: DataFrame, keys: list[str], order: Order, size: Column, budget: int, most: int) -> DataFrame:
    """Rows in order until a count or a cumulated size is reached; the first always stays, the first overflow ends it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = df.withColumn("_rn", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(upto))
    over = ((F.col("_rn") > 1) & (F.col("_sum") > budget)) | (F.col("_rn") > most)
    return running.withColumn("_over", F.max(over.cast("int")).over(upto)).where("_over = 0").drop("_rn", "_sum", "_over")


def retention(df: DataFrame, key: str, period: str, count: str, least: float) -> DataFrame:
    """Each period's count against the period before, and whether it holds ``least`` of it."""
    before = F.lag(count).over(Window.partitionBy(key).orderBy(period))
    ratio = F.round(F.col(count) / before, 6)
    return df.select(key, period, count, before.alias("previous"), ratio.alias("ratio"), F.coalesce(ratio >= least, F.lit(True)).alias("passed"))


def round_robin(df: DataFrame, strata: list[str], draw: Column, n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn; within a stratum by ``draw``."""
    w = Window.partitionBy(*strata).orderBy(draw)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest SHA-256 of the key: the same ones at every run."""
    return df.orderBy(F.sha2(F.col(key).cast("string").cast("binary"), 256), key).limit(n)


def manifest(df: DataFrame, partition: str, key: Column, payload: Column, partitions: DataFrame | None = None, digits: int = 2, levels: int = 1) -> DataFrame:
    """Count, least and greatest key, and digest of the ordered rows of each partition.

    A partition's rows are digested in buckets, by the first hex ``digits`` of the
    key's SHA-256, and the buckets' digests in order make the partition's: no task gathers a
    whole partition. ``levels`` stages of ``digits`` each keep buckets small in larger tables: 16 ** (digits * levels) buckets
    are digested first, and each stage after that takes 16 ** digits digests together. The checksum depends on
    both, so they are part of a manifest's version. ``partitions`` lists those that must appear though they are empty.
    """
    rows = df.select(partition, key.cast("string").alias("_key"), F.sha2(payload.cast("binary"), 256).alias("_sha"))
    bucket = F.substring(F.sha2(F.col("_key").cast("binary"), 256), 1, digits * levels)
    parts = rows.groupBy(partition, bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"), ordered_digest(F.col("_key"), F.col("_sha")).alias("_digest")
    )
    for level in range(levels - 1, 0, -1):
        above = F.substring("_bucket", 1, digits * level).alias("_above")
        parts = parts.groupBy(partition, above).agg(
            F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), ordered_digest(F.col("_bucket"), F.col("_digest")).alias("_digest")
        ).withColumnRenamed("_above", "_bucket")
    found = parts.groupBy(partition).agg(
        F.sum("_n").alias("row_count"), F.min("_low").alias("min_key"), F.max("_high").alias("max_key"), ordered_digest(F.col("_bucket"), F.col("_digest")).alias("checksum")
    )
    if partitions is None:
        return found
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return partitions.join(found, partition, "left").select(partition, F.coalesce("row_count", F.lit(0)).alias("row_count"), "min_key", "max_key", F.coalesce("checksum", empty).alias("checksum"))


def three_valued(column: Column, wanted: list, listed: bool = False) -> Column:
    """Filter that keeps the unknown: null passes, a value must be wanted; an empty list of wishes passes all."""
    if not wanted:
        return F.lit(True)
    hit = F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if listed else column.isin(wanted)
    return F.coalesce(hit, F.lit(True))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, null conditions included as holding; null if none does."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def checkpoints(old: DataFrame, new: DataFrame, keys: list[str], last: str, rows: str = "rows_written") -> DataFrame:
    """Checkpoints with a batch's put in: the greatest ``last`` key of each, and rows written added up."""
    both = old.select(*keys, last, rows).unionByName(new.select(*keys, last, rows))
    return both.groupBy(*keys).agg(F.max(last).alias(last), F.sum(rows).alias(rows))

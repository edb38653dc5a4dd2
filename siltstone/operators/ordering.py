"""Orders without one task that sees them all: ranks over a whole table, and the row before in a group of any size.

Both cut an integer order into ranges. What crosses a range is a row a range, and ranges of ranges where these are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 1_000  # ranges that one range of the level above holds


def global_rank(df: DataFrame, order: str, rank: str = "rank", width: int = 1_000, fan: int = FAN) -> DataFrame:
    """``df`` with ``rank``, its row number from 0 by the integer ``order``; equal values are in no stated order, nulls come last and without a rank.

    A window sees ``width`` values or ``fan`` ranges at most: there are as many levels as the values' extent asks for.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn(rank, F.lit(None).cast("long"))
    levels, ranges = 1, (high - low) // width + 1
    while ranges > fan:
        levels, ranges = levels + 1, -(-ranges // fan)
    own = lambda level: F.floor((F.col(order) - F.lit(low)) / F.lit(width * fan**level)).cast("long")
    counts = df.where(F.col(order).isNotNull()).groupBy(own(0).alias("_r0")).agg(F.count(F.lit(1)).alias("_n"))
    starts = None
    for level in range(levels - 1, -1, -1):
        bucket = F.floor(F.col("_r0") / F.lit(fan**level)).cast("long")
        sums = counts.groupBy(bucket.alias("_b")).agg(F.sum("_n").alias("_n")).withColumn("_up", F.floor(F.col("_b") / fan).cast("long"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("_start", before)
        if starts is not None:
            sums = sums.join(starts, "_up").withColumn("_start", F.col("_start") + F.col("_above"))
        starts = sums.select(F.col("_b").alias("_up"), F.col("_start").alias("_above"))
    place = F.row_number().over(Window.partitionBy("_up").orderBy(order)) - 1
    ranked = df.withColumn("_up", own(0)).withColumn("_place", place).join(starts, "_up", "left")
    return ranked.withColumn(rank, (F.col("_above") + F.col("_place")).cast("long")).drop("_up", "_place", "_above")


def before(df: DataFrame, keys: list[str], order: str, value: str, name: str = "before", width: int = 10_000) -> DataFrame:
    """``df`` with ``name``, the ``value`` of the row before it in its group by the integer ``order``; null for the first, and where that row has none.

    A group is cut into ranges of ``width`` of the order; the first row of a range takes the last one of the range before, so a hot group is many tasks' work.
    ``order`` must tell the rows of a group apart. Null keys are a group; rows without order have no row before and are no one's.
    """
    chunk = F.floor(F.col(order) / F.lit(width)).cast("long")
    rows = df.withColumn("_chunk", chunk)
    known = rows.where(F.col(order).isNotNull())
    row = F.struct(F.col(value).alias("v"))
    ends = known.groupBy(*keys, "_chunk").agg(F.max_by(row, order).alias("_last"))
    ends = ends.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).alias("e")
    own = Window.partitionBy(*keys, "_chunk").orderBy(order)
    inner = rows.withColumn("_own", F.lag(row).over(own)).alias("a")
    on: Column = F.col("a._chunk") == F.col("e._chunk")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}"))
    joined = inner.join(ends, on, "left").select("a.*", "e._last")
    found = F.coalesce(F.col("_own"), F.col("_last"))
    return joined.withColumn(name, F.when(F.col(order).isNotNull(), found["v"])).drop("_chunk", "_own", "_last")

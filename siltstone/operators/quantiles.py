"""Percentiles of groups of any size: sketches that merge, and exact ones by way of them.

A sketch answers any rank within an error that its size states, and sketches of windows, days or shards merge into that of all, so
they are stored and added up. An exact percentile is found between two of its answers: what lies below is only counted,
and only the values between them, a hundredth of a group, are sorted. So no group's values meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import cut

K = 2_000  # size of a sketch


def rank_error(k: int = K) -> float:
    """What a rank is off at most, as a share of the rows, in 99 of 100 cases."""
    return 2.296 / k**0.9723


def sketches(df: DataFrame, keys: list, value: str, k: int = K) -> DataFrame:
    """(keys, n, sketch) of the numbers in ``value``; nulls and NaN don't count, and a group of nothing else has no row. ``keys`` may be columns such as windows."""
    number = F.col(value).cast("double")
    return df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(number, k).alias("sketch"))


def merged(stored: DataFrame, keys: list, k: int = K) -> DataFrame:
    """(keys, n, sketch): the sketches of ``stored`` (n, sketch and keys) put together."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def estimate(sketch: Column, p: float) -> Column:
    """About the value below which the share ``p`` of the rows lies."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], k: int = K) -> DataFrame:
    """(keys, n, one column for each name in ``ps``): exact percentiles, linear between the two nearest ranks.

    Nulls and NaN don't count; a group of nothing else has no row. Null keys are a group. Whether the target ranks lie between a sketch's answers is checked by counting,
    and where they don't the bounds are widened until they do, so the result does not depend on the sketch.
    """
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_v"))
    known = cut(sketches(rows, keys, "_v", k), "sketches")
    names = list(ps)
    on = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys), F.lit(True))
    wide = 3 * rank_error(k)
    while True:
        low = lambda p: F.lit(float("-inf")) if p - wide <= 0 else estimate(F.col("sketch"), p - wide)  # noqa: B023, E731
        high = lambda p: F.lit(float("inf")) if p + wide >= 1 else estimate(F.col("sketch"), p + wide)  # noqa: B023, E731
        bounds = cut(known.select(*keys, "n", *(low(p).alias(f"_low{i}") for i, p in enumerate(ps.values())), *(high(p).alias(f"_high{i}") for i, p in enumerate(ps.values()))), "bounds")
        met = rows.alias("a").join(bounds.alias("b"), on("a", "b")).select("a._v", *(f"b.{c}" for c in bounds.columns))
        counts = [F.count_if(F.col("_v") < F.col(f"_low{i}")).alias(f"_below{i}") for i in range(len(ps))] + [F.count_if(F.col("_v") <= F.col(f"_high{i}")).alias(f"_upto{i}") for i in range(len(ps))]
        counted = cut(met.groupBy(*keys).agg(F.first("n").alias("n"), *counts), "counted")
        rank = lambda p: F.lit(float(p)) * (F.col("n") - 1)
        outside = F.lit(False)
        for i, p in enumerate(ps.values()):
            outside = outside | (F.floor(rank(p)) < F.col(f"_below{i}")) | (F.ceil(rank(p)) >= F.col(f"_upto{i}"))
        if counted.where(outside).isEmpty():
            break
        wide *= 4
    each = F.array(*(F.when((F.col("_v") >= F.col(f"_low{i}")) & (F.col("_v") <= F.col(f"_high{i}")), F.lit(i)) for i in range(len(ps))))
    inside = met.select(*keys, "_v", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_p")).groupBy(*keys, "_p", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    placed = inside.withColumn("_end", upto).alias("a").join(counted.alias("b"), on("a", "b")).select(*(f"b.{c}" for c in counted.columns), "a._v", "a._p", "a._n", "a._end")
    below = F.coalesce(*(F.when(F.col("_p") == i, F.col(f"_below{i}")) for i in range(len(ps))))
    target = F.coalesce(*(F.when(F.col("_p") == i, rank(p)) for i, p in enumerate(ps.values())))
    placed = placed.select(*keys, "n", "_p", "_v", (below + F.col("_end") - F.col("_n")).alias("_from"), (below + F.col("_end")).alias("_to"), target.alias("_rank"))
    at = lambda r: F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v")))
    found = placed.groupBy(*keys, "n", "_p").agg(at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b"), F.first("_rank").alias("_rank"))
    part = F.col("_rank") - F.floor("_rank")
    line = F.col("_a") * (1 - part) + F.col("_b") * part
    return found.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("_p") == i, line)).alias(name) for i, name in enumerate(names)))

"""Samples with quotas: floors for groups, quotas for overlapping strata, the same rows at every run."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.relational import top_per_key
from siltstone.storage import cut


def _greedy(heads: dict[tuple, list[tuple]], floors: Counter, quotas: Counter, most: int, weight: int) -> list:
    """Keys chosen one by one: the most needs met first, ties by draw. ``heads``: (group, strata) -> [(draw, key)] in order.

    A class's worth only falls while needs are met, so a class that comes up with an old worth goes back with its new one.
    """
    worth = lambda c: weight * (floors[c[0]] > 0) + sum(quotas[s] > 0 for s in c[1])
    waiting = [(-worth(c), rows[0], c, 0) for c, rows in heads.items() if worth(c)]
    heapq.heapify(waiting)
    chosen: list = []
    while waiting and (any(n > 0 for n in floors.values()) or any(n > 0 for n in quotas.values())):
        old, row, c, at = heapq.heappop(waiting)
        now = worth(c)
        if not now:
            continue
        if -old != now:
            heapq.heappush(waiting, (-now, row, c, at))
            continue
        chosen.append(row[1])
        if len(chosen) > most:
            raise ValueError("the sample is too small for its floors and quotas")
        floors[c[0]] -= 1
        for s in c[1]:
            quotas[s] -= 1
        if at + 1 < len(heads[c]):
            heapq.heappush(waiting, (-worth(c), heads[c][at + 1], c, at + 1))
    if any(n > 0 for n in floors.values()) or any(n > 0 for n in quotas.values()):
        raise ValueError("floors and quotas can't be met by these rows")
    return chosen


def quota_sample(rows: DataFrame, key: str, group: str, strata: str, draw: str, size: int, floor: int = 30, quota: int = 40, whole: tuple[str, ...] = (), weight: int = 3) -> DataFrame:
    """``size`` of ``rows``, with ``why``: whole, need or fill.

    All rows of the groups in ``whole`` are in it, ``floor`` of every other group (all, if fewer) and ``quota`` of each of the overlapping ``strata`` (an array of names).
    Rows are taken greedily: first the one that meets most needs, its group's counting ``weight``, ties by ``draw`` (a string, such as a digest), then by ``key``; the rest by draw.
    Rows of equal group and strata are worth the same, so of such a class only the first can be taken, as many as its needs add up to: these heads alone reach the
    driver, with a count a group and stratum. Whole groups stay distributed. ``key`` must tell rows apart; a null group is one, null strata are none. Raises
    ValueError if ``size`` is more than there are rows, or too few for the needs.
    """
    if size <= 0:
        raise ValueError("a sample has at least one row")
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = rows.select(F.col(key).alias("k"), named.alias("g"), F.array_sort(F.array_distinct(F.filter(F.coalesce(strata, F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("s"), F.col(draw).alias("d"))
    own = cut(own, "candidates")
    there = {r["g"]: r["n"] for r in own.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    if sum(there.values()) < size:
        raise ValueError(f"only {sum(there.values())} rows for a sample of {size}")
    names = {f"={w}" for w in whole}
    in_whole = F.col("g").isin(sorted(names)) if names else F.lit(False)
    per = own.select(in_whole.alias("w"), F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if("w").alias("taken")).collect()  # a row a stratum
    quotas = Counter({r["s"]: min(quota, r["n"]) - r["taken"] for r in per})
    floors = Counter({g: min(floor, n) for g, n in there.items() if g not in names})
    taken = sum(n for g, n in there.items() if g in names)
    if taken > size:
        raise ValueError("the sample is too small for its floors and quotas")
    ranked = top_per_key(own.where(~in_whole), ["g", "s"], [F.col("d"), F.col("k")], floor + quota * len(quotas))
    heads: dict[tuple, list[tuple]] = {}
    for r in ranked.where(F.col("rank") <= floor + quota * F.size("s")).orderBy("rank").collect():
        heads.setdefault((r["g"], tuple(r["s"])), []).append((r["d"], r["k"]))
    chosen = _greedy(heads, floors, quotas, size - taken, weight)
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    needed = spark.createDataFrame([(k,) for k in chosen], f"k {kind}")  # ``size`` rows at most
    rest = own.where(~in_whole).join(needed, "k", "left_anti").orderBy("d", "k").limit(max(0, size - taken - len(chosen)))
    why = own.where(in_whole).select("k", F.lit("whole").alias("why")).unionByName(needed.select("k", F.lit("need").alias("why"))).unionByName(rest.select("k", F.lit("fill").alias("why")))
    return rows.join(why.withColumnRenamed("k", "_k"), F.col(key) == F.col("_k")).drop("_k")

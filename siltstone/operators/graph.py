"""Graphs and trees in tables: closure, cycles, merge chains, rollups, drill-downs, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import cut, forget

TASK_ROWS = 250_000  # rows that a task groups, as a mean


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", most: int = 64) -> DataFrame:
    """All (child, parent) pairs that a walk of edges joins. Doubling: a walk of length n takes about log2 n rounds."""
    reach = edges.select(child, parent).distinct()
    size, rounds = reach.count(), 0
    while rounds < most:
        step = reach.select(F.col(child), F.col(parent).alias("_via")).join(reach.select(F.col(child).alias("_via"), parent), "_via").select(child, parent)
        after = cut(reach.union(step).distinct(), "closure")
        grown = after.count()
        if rounds:
            forget(reach)  # the first is the caller's
        if grown == size:
            return after
        reach, size, rounds = after, grown, rounds + 1
    raise ValueError(f"no end after {most} rounds")


def cycle_edges(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Edges whose parent reaches their child again."""
    back = closure(edges, child, parent).select(F.col(child).alias(parent), F.col(parent).alias(child))
    return edges.join(back, [child, parent], "left_semi")


def resolve_merges(merges: DataFrame, most: int = 64) -> DataFrame:
    """(id, final) for ``merges`` (id, into): where a chain of merges ends. Pointer jumping; a cycle raises."""
    current = merges.select("id", F.col("into").alias("final"))
    for _ in range(most):
        step = current.join(merges.select(F.col("id").alias("final"), "into"), "final", "left")
        after = cut(step.select("id", F.coalesce("into", "final").alias("next"), "final"), "merges")
        if after.where("next <> final").isEmpty():
            return after.select("id", "final")
        current = after.select("id", F.col("next").alias("final"))
    raise ValueError("merges go round")


def tree_rollup(leaves: DataFrame, groups: DataFrame, group: str, top: str) -> DataFrame:
    """Counts at two levels, groups without a leaf included: (level, top, group, n)."""
    per = leaves.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    low = groups.join(per, group, "left").select(top, F.col(group), F.coalesce("n", F.lit(0)).alias("n"))
    high = low.groupBy(top).agg(F.sum("n").alias("n"))
    return low.select(F.lit(2).alias("level"), top, F.col(group).cast("string").alias("node"), "n").union(high.select(F.lit(1), top, F.lit(None).cast("string"), "n"))


def two_hops(first: DataFrame, second: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Paths start - middle - end: how many, and through how many middles.

    Edges are counted on both sides before they meet, so each middle is a row and no set of middles is kept. Partitions
    are as many as the edges ask for: a task holds the groups of about ``TASK_ROWS`` of them.
    """
    n = max(int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-second.count() // TASK_ROWS))
    left = first.repartition(n, middle).groupBy(start, middle).agg(F.count(F.lit(1)).alias("_left"))
    right = second.repartition(n, middle).groupBy(middle, end).agg(F.count(F.lit(1)).alias("_right"))
    both = left.join(right, middle).select(start, end, (F.col("_left") * F.col("_right")).alias("_paths"))
    return both.repartition(n, start, end).groupBy(start, end).agg(F.sum("_paths").alias("paths"), F.count(F.lit(1)).alias("middles"))


def unmatched_endpoints(edges: DataFrame, nodes: DataFrame, ends: list[str], key: str) -> DataFrame:
    """(side, n): edge ends without a node; a sink must show none."""
    sides = [edges.join(nodes.select(F.col(key).alias(e)).distinct(), e, "left_anti").select(F.lit(e).alias("side")) for e in ends]
    every = edges.sparkSession.createDataFrame([(e,) for e in ends], "side string")
    found = sides[0]
    for s in sides[1:]:
        found = found.union(s)
    return every.join(found.groupBy("side").count(), "side", "left").select("side", F.coalesce("count", F.lit(0)).alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each node: ``edges`` (src, dst) -> (id, component_id).

    Undirected; nodes without an edge don't appear. Each round takes the
    smallest label among the neighbours and then follows labels once
    (pointer jumping), so a chain of length n settles in about log n rounds.
    Neighbours' labels are pre-aggregated before the shuffle, so a hub with a
    third of all edges costs each task one row.
    """
    both = cut(
        edges.where("src <> dst").select("src", "dst").union(edges.where("src <> dst").select(F.col("dst"), F.col("src"))).distinct(),
        "edges",
    )
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("component_id")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("dst"), "component_id"), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("component_id").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.col("component_id").alias("was"), F.least("component_id", "near").alias("now"))
        root = labels.select(F.col("id").alias("now"), F.col("component_id").alias("root"))
        after = cut(step.join(root, "now").select("id", "was", F.least("now", "root").alias("component_id")), "labels")
        settled = after.where("component_id <> was").isEmpty()
        forget(labels)
        labels = after.select("id", "component_id")
        if settled:
            forget(both)
            return labels

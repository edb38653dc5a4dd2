"""Crawl frontier tables: merges of rediscoveries, collapses, resets, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_nodes(old: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes (node_key, status, attempts, priority, owner, metadata map) with rediscovered ones merged in.

    Status and attempts stay, the greatest priority wins, a missing owner is filled, metadata
    keys that are there win. Of several finds of a node the one of least priority gives the metadata, ties to the least as JSON.
    """
    news = found.groupBy("node_key").agg(F.max("priority").alias("p"), F.min("owner").alias("o"), F.min_by("metadata", F.struct("priority", F.to_json("metadata"))).alias("m"))
    empty = F.create_map().cast("map<string,string>")
    mine, other = F.coalesce("metadata", empty), F.coalesce("m", empty)
    merged = F.map_concat(mine, F.map_filter(other, lambda k, v: ~F.map_contains_key(mine, k)))
    return old.join(news, "node_key", "full_outer").select(
        "node_key", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.greatest("priority", "p").alias("priority"), F.coalesce("owner", "o").alias("owner"), merged.alias("metadata")
    )


def collapse_twins(nodes: DataFrame, edges: DataFrame, bare: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, status, url) equal but for the scheme become one, a done one or else the least id; edges (src, dst, kind) follow."""
    keyed = nodes.withColumn("_bare", bare)
    keeper = keyed.groupBy("_bare").agg(F.min_by("id", F.struct((F.col("status") != "done").cast("int").alias("x"), "id")).alias("keeper"))
    moved = keyed.join(keeper, "_bare").select("id", "keeper")
    left = nodes.join(moved.where("id = keeper").select("id"), "id", "left_semi")
    ends = edges.join(moved.toDF("src", "s"), "src", "left").join(moved.toDF("dst", "d"), "dst", "left")
    return left, ends.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "kind").where("src <> dst").dropDuplicates()


def next_up(nodes: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The ``n`` claimable nodes of highest priority, then least id."""
    due = (F.col("status") == "pending") | ((F.col("status") == "retry") & (F.col("next_retry_at") <= now))
    return nodes.where(due).orderBy(F.desc("priority"), "id").limit(n)


def over_budget(nodes: DataFrame, owner: str, kinds: list[str], budget: int) -> DataFrame:
    counts = nodes.groupBy(owner).agg(F.count_if(F.col("type").isin(kinds)).alias("n"))
    return counts.withColumn("over", F.col("n") >= budget)


def reset_subtree(nodes: DataFrame, edges: DataFrame, owner: str, entry_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes below ``owner`` go, their edges too; its entry points start over."""
    below = F.col("owner").eqNullSafe(F.lit(owner))
    first = F.col("type").isin(entry_types)
    left = nodes.where(~below | first).withColumn("status", F.when(below & first, "pending").otherwise(F.col("status"))).withColumn("attempts", F.when(below & first, 0).otherwise(F.col("attempts")))
    gone = nodes.where(below & ~first).select("id")
    return left, edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")


def unavailable(text: Column, most: int = 4000) -> Column:
    """Why a short page is no page: not found, removed, empty; else null."""
    short = F.length(text) <= most
    low = F.lower(text)
    return F.when(~text.rlike(r"(?U)\S"), "empty_page").when(short & low.rlike(r"\b404\b|not found|页面不存在"), "not_found").when(short & low.rlike("has been removed|已删除|no longer available"), "removed")

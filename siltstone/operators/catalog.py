"""Catalogue upkeep: overrides, tombstones, aliases, concept links, pools, previews, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.relational import latest_value


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` taken from the latest active override (keys, version, set_at, value, active) where there is one."""
    last = latest_value(overrides.where("active"), keys, ["value"], ["version", "set_at"])
    return rows.join(last, keys, "left").withColumn(column, F.coalesce("value", column)).drop("value")


def next_versions(overrides: DataFrame, keys: list[str]) -> DataFrame:
    return overrides.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def tombstones(previous: DataFrame, current: DataFrame, key: str, by: list[str], columns: list[str]) -> DataFrame:
    """Latest previous row of every key that the current build lacks, marked inactive."""
    return latest_value(previous, [key], columns, by).join(current.select(key).distinct(), key, "left_anti").withColumn("active", F.lit(False))


def stale(claims: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """Claims with ``active`` false where their observation isn't in the build any more."""
    seen = observations.select(key).distinct().withColumn("_seen", F.lit(True))
    return claims.join(seen, key, "left").withColumn("active", F.col("active") & F.coalesce("_seen", F.lit(False))).drop("_seen")


def ambiguous_aliases(aliases: DataFrame, alias: str, topic: str) -> DataFrame:
    """Alias keys that more than one topic claims."""
    return aliases.groupBy(F.lower(alias).alias("alias_key")).agg(F.countDistinct(topic).alias("n_topics")).where("n_topics > 1")


def match_aliases(concepts: DataFrame, aliases: DataFrame, choices: DataFrame) -> DataFrame:
    """Topic of each concept (concept_id, name): by exact alias, else by the choice made for it, else none."""
    exact = aliases.groupBy(F.lower("alias").alias("_key")).agg(F.min("topic_id").alias("by_alias"), F.countDistinct("topic_id").alias("_n")).where("_n = 1").drop("_n")
    rows = concepts.withColumn("_key", F.lower("name")).join(exact, "_key", "left").join(choices.select("concept_id", F.col("topic_id").alias("by_choice")), "concept_id", "left")
    method = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_choice").isNotNull(), "semantic").otherwise("provisional")
    return rows.select("concept_id", F.coalesce("by_alias", "by_choice").alias("topic_id"), method.alias("method"))


def link_status(links: DataFrame, statement: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Links (statement, kind, relation, method) with status: review for a relation that the kind doesn't allow, a provisional topic or a second primary."""
    primaries = F.sum((F.col("relation") == "primary").cast("int")).over(Window.partitionBy(statement))
    fits = F.lit(False)
    for kind, relations in allowed.items():
        fits = fits | ((F.col("kind") == kind) & F.col("relation").isin(relations))
    bad = ~fits | (F.col("method") == "provisional") | ((F.col("relation") == "primary") & (primaries > 1))
    return links.withColumn("status", F.when(bad, "review").otherwise("approved"))


def pool(lists: dict[str, DataFrame], query: str, doc: str) -> DataFrame:
    """Union of ranked lists, a row a query and document, with where it appeared and its best rank."""
    rows = None
    for name, df in lists.items():
        part = df.select(query, doc, "rank", F.lit(name).alias("experiment"))
        rows = part if rows is None else rows.unionByName(part)
    seen = F.array_sort(F.collect_list(F.concat_ws(":", "experiment", F.col("rank").cast("string"))))
    return rows.groupBy(query, doc).agg(F.min("rank").alias("best_rank"), F.array_join(seen, ",").alias("appearances"))


def preview(nodes: DataFrame, edges: DataFrame, label_order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Half of ``limit`` nodes by label, then the edges with both ends among them, as many again."""
    place = F.lit(len(label_order))
    for i, label in enumerate(label_order):
        place = F.when(F.col("label") == label, i).otherwise(place)
    shown = nodes.orderBy(place, "id").limit(limit // 2)
    ends = shown.select("id")
    inside = edges.join(ends.toDF("src"), "src", "left_semi").join(ends.toDF("dst"), "dst", "left_semi")
    return shown, inside.orderBy("src", "dst").limit(limit // 2)


def cached(profiles: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Profiles that the cache has, with their value, and those that must be computed."""
    return profiles.join(cache, keys), profiles.join(cache.select(keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def containing(texts: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """A row for each text and needle that it contains, case aside; needles are a literal list."""
    hits = F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(F.lower(text), F.lower(n)))
    return texts.withColumn("needle", F.explode(hits))


def strata(flags: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def preferred(strict: DataFrame, relaxed: DataFrame, query: str, entity: str) -> DataFrame:
    """Strict results first, then relaxed ones that they lack, ranked on."""
    both = strict.select(query, entity, "rank", F.lit(0).alias("tier")).unionByName(relaxed.join(strict.select(query, entity), [query, entity], "left_anti").select(query, entity, "rank", F.lit(1).alias("tier")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("tier", "rank", entity)))


def choose_facet(links: DataFrame, page: str) -> DataFrame:
    """What a list page does with its facet links (page, url, is_all, resets, axis_rank, people_reachable).

    The link to all of them wins (most resets, then axis, then url); else nothing is
    followed where people are reachable already; else one axis is descended.
    """
    best = Window.partitionBy(page).orderBy(F.desc("is_all"), F.desc("resets"), "axis_rank", "url")
    w = Window.partitionBy(page)
    rows = links.withColumn("_rn", F.row_number().over(best)).withColumn("_all", F.max("is_all").over(w)).withColumn("_people", F.max("people_reachable").over(w)).withColumn("_axis", F.min("axis_rank").over(w))
    kept = F.when(F.col("_all"), F.col("_rn") == 1).when(F.col("_people"), F.lit(False)).otherwise(F.col("axis_rank") == F.col("_axis"))
    return rows.withColumn("followed", kept).drop("_rn", "_all", "_people", "_axis")


def iso_utc(text: Column) -> Column:
    """ISO time as UTC timestamp; without zone it is UTC, whatever the session's is, and what is no time is null."""
    clean = F.trim(text)
    timed = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(clean, F.lit("T00:00:00"))).otherwise(clean)
    return F.try_to_timestamp(F.when(timed.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$"), timed).otherwise(F.concat(timed, F.lit("Z"))))


def string_list(json: Column) -> Column:
    """Strings of a JSON list, each once, in order; an empty list for anything else."""
    found = F.from_json(json, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.array_distinct(F.array_compact(found)), F.array().cast("array<string>"))


def eligible(rows: DataFrame, build: str, excluded: str = "excluded") -> DataFrame:
    """Active rows of a build whose role isn't excluded; an unknown role is."""
    return rows.where((F.col("build_id") == build) & F.col("active") & F.coalesce(F.col("role_status") != excluded, F.lit(False)))


def chosen_topics(candidates: DataFrame, choices: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, topic, score, rank): the candidate topic (key, id, score, rank) that was chosen for each concept (key, choice).

    A choice that is no candidate, or none, leaves the concept without a topic.
    """
    picked = candidates.withColumnRenamed("id", "choice")
    return choices.join(picked, [key, "choice"], "left").select(key, F.when(F.col("rank").isNotNull(), F.col("choice")).alias("topic"), "score", "rank")

"""Graph and vector exports: rows of partitions, read-back comparison, the gates of a release."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.vectors import finite
from siltstone.operators.graph import cycle_edges
from siltstone.operators.relational import manifest


def canonical_json(columns: Sequence[str]) -> Column:
    """The columns as one JSON object, names sorted, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def _exported(df: DataFrame, partition: str, key: Column, columns: Sequence[str]) -> DataFrame:
    rows = df.select(F.lit(partition).alias("partition"), key.alias("row_key"), canonical_json(columns).alias("payload"))
    return rows.withColumn("payload_sha256", F.sha2(F.col("payload").cast("binary"), 256))


def _one_each(df: DataFrame, keys: list[str], properties: Sequence[str]) -> DataFrame:
    """A row a key: of rows that repeat one, that of the least payload, the same at every run."""
    rest = [c for c in dict.fromkeys(properties) if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), canonical_json(rest)).alias("_row")).select(*keys, "_row.*")


def node_rows(df: DataFrame, label: str, key: str, properties: Sequence[str]) -> DataFrame:
    """partition, row_key, payload, payload_sha256: the nodes of one label, a row each key."""
    return _exported(_one_each(df.where(F.col(key).isNotNull()), [key], properties), f"node:{label}", F.concat(F.lit(f"{label}:"), F.col(key).cast("string")), [key, *properties])


def edge_rows(df: DataFrame, kind: str, source: str, target: str, properties: Sequence[str] = ()) -> DataFrame:
    """The same for the edges of one kind: a row for each pair of ends that are both there."""
    there = _one_each(df.where(F.col(source).isNotNull() & F.col(target).isNotNull()), [source, target], properties)
    key = F.concat(F.col(source).cast("string"), F.lit(f"-{kind}-"), F.col(target).cast("string"))
    return _exported(there, f"edge:{kind}", key, [source, target, *properties])


def read_back(expected: DataFrame, actual: DataFrame, key: str = "partition") -> DataFrame:
    """What differs between two manifests (row_count, min_key, max_key, checksum), a row a partition; null where nothing does."""
    a, b = expected.alias("a"), actual.alias("b")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    reason = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "unexpected")
    for c in ("row_count", "min_key", "max_key", "checksum"):
        reason = reason.when(differs(c), c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), reason.alias("difference"))


def vector_rows(df: DataFrame, key: str, vector: str, payload: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """Points (point_id, vector, payload) of finite vectors; fields in ``sensitive`` never leave."""
    kept = [c for c in payload if c not in set(sensitive)]
    return df.where(F.col(vector).isNotNull() & finite(F.col(vector))).select(F.col(key).alias("point_id"), F.col(vector).alias("vector"), canonical_json(kept).alias("payload"))


def check(name: str, actual: DataFrame, expected: str = "0") -> DataFrame:
    """One gate: (name, passed, expected, actual); ``actual`` is one row of one column."""
    value = F.coalesce(F.col(actual.columns[0]).cast("string"), F.lit("0"))
    return actual.select(F.lit(name).alias("name"), (value == expected).alias("passed"), F.lit(expected).alias("expected"), value.alias("actual"))


def count_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def release_gates(
    runs: DataFrame, findings: DataFrame, active: DataFrame, observations: DataFrame, claims: DataFrame, statements: DataFrame, edges: DataFrame, links: DataFrame, tree: DataFrame, profiles: DataFrame, units: DataFrame
) -> DataFrame:
    """All gates as one table.

    ``runs`` (source, status, rows_read, rows_written, rows_rejected), ``findings`` (source), ``active`` (entity_id, eligible, units array),
    ``observations`` (entity_id), ``claims`` (kind, value, entity_id, strength), ``statements`` (statement_id, entity_id), ``edges`` (provenance),
    ``links`` (compatible), ``tree`` (child, parent), ``profiles`` (entity_id), ``units`` (entity_id, unit).
    """
    explained = runs.groupBy("source").agg(F.sum("rows_rejected").alias("rejected")).join(findings.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left")
    owners = claims.where("strength = 'strong'").groupBy("kind", "value").agg(F.count_distinct("entity_id").alias("n"))
    mine = units.groupBy("entity_id").agg(F.array_sort(F.collect_set("unit")).alias("there"))
    same = F.coalesce(F.array_sort(F.array_distinct("units")), F.array().cast("array<string>")).eqNullSafe(F.coalesce("there", F.array().cast("array<string>")))
    parts = [
        check("stage_runs_completed", count_of(runs.where(~F.col("status").eqNullSafe("COMPLETED")))),
        check("source_observation_coverage", count_of(runs.where("rows_read <> rows_written + rows_rejected"))),
        check("source_rejections_explained", count_of(explained.where("coalesce(n, 0) < rejected"))),
        check("active_canonical_has_observation", count_of(active.join(observations, "entity_id", "left_anti"))),
        check("strong_claim_uniqueness", count_of(owners.where("n > 1"))),
        check("research_statement_traceability", count_of(statements.join(observations, "entity_id", "left_anti"))),
        check("graph_provenance_parseable", count_of(edges.where(~F.coalesce(F.col("provenance").startswith("["), F.lit(False))))),
        check("topic_link_compatibility", count_of(links.where(~F.col("compatible")))),
        check("topic_dag_cycles", count_of(cycle_edges(tree))),
        check("eligible_profiles", count_of(active.where("eligible").join(profiles, "entity_id", "left_anti"))),
        check("org_units", count_of(active.join(mine, "entity_id", "left").where(~same))),
    ]
    return reduce(DataFrame.unionByName, parts)


def threshold(name: str, metrics: DataFrame) -> DataFrame:
    """A gate over ``metrics`` (metric, value, least): how many lie below their least value, or have none."""
    return check(name, count_of(metrics.where(~F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))))


def integrity_gates(
    rows: DataFrame, stored: DataFrame, profiles: DataFrame, cached: DataFrame, gold: dict[str, DataFrame], eligible: DataFrame, points: DataFrame, sensitive: Sequence[str], pointers: DataFrame, readiness: DataFrame, damaged: DataFrame
) -> DataFrame:
    """The gates on what was written, as one table like that of :func:`release_gates`.

    ``rows`` (partition, row_key, payload) against the ``stored`` manifest; ``profiles`` and ``cached`` (entity_id, profile_hash); ``gold``: for
    each name metrics (metric, value, least); ``eligible`` (entity_id) against ``points`` (point_id, payload as JSON), which must not name a field in ``sensitive``;
    ``pointers`` (name, version): all name one version; ``readiness`` metrics; ``damaged``: a row for each part of an index that isn't as it was written.
    """
    again = manifest(rows, "partition", F.col("row_key"), F.col("payload"))
    differ = read_back(stored, again).where("difference IS NOT NULL")
    hashes = profiles.alias("a").join(cached.alias("b"), "entity_id", "left").where(~F.col("a.profile_hash").eqNullSafe(F.col("b.profile_hash")))
    ids, there = eligible.select(F.col("entity_id").alias("id")).distinct(), points.select(F.col("point_id").alias("id")).distinct()
    strangers = ids.join(there, "id", "full_outer").join(ids.withColumn("_a", F.lit(1)), "id", "left").join(there.withColumn("_b", F.lit(1)), "id", "left").where("_a IS NULL OR _b IS NULL")
    told = F.lit(False)
    for field in sensitive:
        told = told | F.array_contains(F.json_object_keys("payload"), field)
    parts = [
        check("catalog_graph_manifest", count_of(differ)),
        check("catalog_graph_profile_hash", count_of(hashes)),
        *(threshold(name, metrics) for name, metrics in gold.items()),
        check("vector_count", eligible.agg(F.count_distinct("entity_id").alias("a")).crossJoin(points.agg(F.count(F.lit(1)).alias("b"))).select((F.col("b") - F.col("a")).alias("n"))),
        check("vector_ids", count_of(strangers)),
        check("vector_payload", count_of(points.where(F.coalesce(told, F.lit(True)) | F.json_object_keys("payload").isNull()))),
        check("promotion_pointers", pointers.agg(F.count_distinct("version").alias("n")), "1"),
        threshold("readiness", readiness),
        check("index_integrity", count_of(damaged)),
    ]
    return reduce(DataFrame.unionByName, parts)

"""Queries of exports and release gates over the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import export, relational
from siltstone.plans.registry import Registry, table
from siltstone.storage import cut

QUERIES = Registry()


def _sql_rows(partition: str, key: str, payload: str, source: str) -> str:
    return f"SELECT '{partition}' AS partition, {key} AS row_key, {payload} AS payload FROM {source}"


_NODES = " UNION ALL ".join(
    [
        _sql_rows("node:Region", "'Region:' || r_regionkey", "to_json({'r_name': r_name, 'r_regionkey': r_regionkey})", "region"),
        _sql_rows("node:Nation", "'Nation:' || n_nationkey", "to_json({'n_name': n_name, 'n_nationkey': n_nationkey})", "nation"),
        _sql_rows("node:Customer", "'Customer:' || c_custkey", "to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name})", "customer"),
        _sql_rows("node:Order", "'Order:' || o_orderkey", "to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})", "orders"),
    ]
)
_EDGES = " UNION ALL ".join(
    [
        _sql_rows("edge:IN_REGION", "n_nationkey || '-IN_REGION-' || n_regionkey", "to_json({'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey})", "nation"),
        _sql_rows("edge:IN_NATION", "c_custkey || '-IN_NATION-' || c_nationkey", "to_json({'c_custkey': c_custkey, 'c_nationkey': c_nationkey})", "customer"),
        _sql_rows("edge:PLACED", "o_custkey || '-PLACED-' || o_orderkey", "to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority})", "orders"),
        _sql_rows("edge:CONTAINS", "l_orderkey || '-CONTAINS-' || l_partkey", "to_json({'l_orderkey': l_orderkey, 'l_partkey': l_partkey})", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    ]
)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda name: table(spark, sf_dir, name)
    parts = [export.node_rows(own("region"), "Region", "r_regionkey", ["r_name"]), export.node_rows(own("nation"), "Nation", "n_nationkey", ["n_name"])]
    parts += [export.node_rows(own("customer"), "Customer", "c_custkey", ["c_name", "c_mktsegment"]), export.node_rows(own("orders"), "Order", "o_orderkey", ["o_orderstatus"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@QUERIES.add(f"SELECT *, sha256(payload) AS payload_sha256 FROM ({_NODES})")
def graph_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


@QUERIES.add(f"SELECT *, sha256(payload) AS payload_sha256 FROM ({_EDGES})")
def graph_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda name: table(spark, sf_dir, name)
    parts = [export.edge_rows(own("nation"), "IN_REGION", "n_nationkey", "n_regionkey"), export.edge_rows(own("customer"), "IN_NATION", "c_custkey", "c_nationkey")]
    parts += [export.edge_rows(own("orders"), "PLACED", "o_custkey", "o_orderkey", ["o_orderpriority"]), export.edge_rows(own("lineitem").select("l_orderkey", "l_partkey"), "CONTAINS", "l_orderkey", "l_partkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@QUERIES.add(
    f"""
    WITH n AS ({_NODES}) SELECT partition, CASE partition WHEN 'node:Customer' THEN 'row_count' WHEN 'node:Region' THEN 'missing' END AS difference FROM n GROUP BY partition
    UNION ALL SELECT 'node:Other', 'unexpected'"""
)
def export_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export written and read again: a partition lost, one that is new, and one that lacks a row."""
    rows = _nodes(spark, sf_dir)
    there = cut(rows, "export")
    spoilt = there.where("partition <> 'node:Region' AND row_key <> 'Customer:1'").unionByName(there.where("partition = 'node:Region'").withColumn("partition", F.lit("node:Other")))
    sums = lambda df: relational.manifest(df, "partition", F.col("row_key"), F.col("payload"))
    return export.read_back(sums(rows), sums(spoilt))


@QUERIES.add(
    """
    SELECT vec_id AS point_id, len(embedding) AS size, to_json({'label': label, 'vec_id': vec_id}) AS payload FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
)
def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the vector collection; the mail of their rows never leaves."""
    rows = table(spark, sf_dir, "embeddings").withColumn("email", F.lit("a@b.c"))
    return export.vector_rows(rows, "vec_id", "embedding", ["vec_id", "label", "email"], ["email"]).select("point_id", F.size("vector").cast("long").alias("size"), "payload")


@QUERIES.add(
    """
    WITH g(name, actual) AS (
      SELECT 'stage_runs_completed', count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
      UNION ALL SELECT 'source_observation_coverage', 0
      UNION ALL SELECT 'source_rejections_explained', count(*) FROM (SELECT o_orderpriority, count_if(o_orderstatus = 'P') AS rejected, count_if(o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS n FROM orders GROUP BY 1) WHERE n < rejected
      UNION ALL SELECT 'active_canonical_has_observation', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT 'strong_claim_uniqueness', count(*) FROM (SELECT o_orderpriority, o_orderdate FROM orders GROUP BY ALL HAVING count(DISTINCT o_custkey) > 1)
      UNION ALL SELECT 'research_statement_traceability', count(*) FROM customer WHERE c_custkey + 3 NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT 'graph_provenance_parseable', count(*) FROM events WHERE event_id % 10 = 0
      UNION ALL SELECT 'topic_link_compatibility', count(*) FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'topic_dag_cycles', 2
      UNION ALL SELECT 'eligible_profiles', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 6 = 0
      UNION ALL SELECT 'org_units', count(*) FROM customer WHERE c_custkey % 9 = 0)
    SELECT name, actual = 0 AS passed, '0' AS expected, CAST(actual AS VARCHAR) AS actual FROM g"""
)
def release_gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named gate over the star schema, with faults planted so that most of them fail."""
    orders, customers, events = (table(spark, sf_dir, t) for t in ("orders", "customer", "events"))
    lost = F.col("o_orderstatus") == "P"
    by_source = orders.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(lost).alias("rows_rejected"), F.count_if(~lost).alias("rows_written"), F.bool_or(lost).alias("any"))
    runs = by_source.withColumn("status", F.when(F.col("any") & (F.col("source") == "1-URGENT"), "FAILED").otherwise("COMPLETED"))
    key, unit = F.col("c_custkey"), F.col("c_mktsegment")
    active = customers.select(key.alias("entity_id"), (key % 2 == 0).alias("eligible"), F.array(unit, unit).alias("units"))
    tree = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), F.when(F.col("n_nationkey") == 0, 1).when(F.col("n_nationkey") == 1, 0).otherwise(F.col("n_nationkey") - 1).cast("int").alias("parent"))
    return export.release_gates(
        runs,
        orders.where(lost & (F.col("o_orderkey") % 2 == 0)).select(F.col("o_orderpriority").alias("source")),
        active,
        orders.select(F.col("o_custkey").alias("entity_id")),
        orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("value"), F.col("o_custkey").alias("entity_id"), F.lit("strong").alias("strength")),
        customers.select(key.alias("statement_id"), (key + 3).alias("entity_id")),
        events.select(F.when(F.col("event_id") % 10 != 0, "[1]").otherwise(None).alias("provenance")),
        events.select((F.col("event_type") != "error").alias("compatible")),
        tree,
        customers.where(key % 6 != 0).select(key.alias("entity_id")),
        customers.select(key.alias("entity_id"), F.when(key % 9 == 0, "other").otherwise(unit).alias("unit")),
    )

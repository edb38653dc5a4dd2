"""Queries of the relational kit over the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph, ordering, quality, relational
from siltstone.plans.registry import Registry, table

QUERIES = Registry()


@QUERIES.add(
    """
    SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = relational.latest_value(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"], ["o_orderdate", "o_orderkey"])
    return last.withColumn("o_totalprice", F.round("o_totalprice", 2))


@QUERIES.add(
    """
    SELECT o_custkey, o_orderstatus AS status, o_orderkey AS observation, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.6 ELSE 0.4 END DESC, o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders) WHERE rn = 1"""
)
def scalar_survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best claim of a field by grade, time, observation."""
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", 0.9).when(F.col("o_orderpriority") == "2-HIGH", 0.6).otherwise(0.4)
    claims = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("observation"), grade.alias("confidence"), "o_orderdate")
    return relational.latest_value(claims, ["o_custkey"], ["status", "observation", "confidence"], ["confidence", "o_orderdate", "observation"])


@QUERIES.add(
    """
    SELECT o_custkey, string_agg(o_orderpriority, '；' ORDER BY o_orderkey) AS o_orderpriority, count(*) AS n_values FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderpriority IS NOT NULL)
    WHERE rn = 1 GROUP BY o_custkey"""
)
def ordered_union_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ordered_union(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", [F.col("o_orderkey")])


@QUERIES.add(
    """
    WITH n AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL),
    p AS (SELECT *, lag(n) OVER (PARTITION BY o_orderstatus ORDER BY y) AS previous FROM n)
    SELECT o_orderstatus, y, n, previous, round(n / previous, 6) AS ratio, coalesce(round(n / previous, 6) >= 0.9, true) AS passed FROM p"""
)
def retention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return relational.retention(counts, "o_orderstatus", "y", "n", 0.9)


@QUERIES.add(
    """
    SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (
      SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""
)
def anti_no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@QUERIES.add(
    """
    SELECT l_suppkey, count(*) AS orphans FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderkey IS NULL GROUP BY l_suppkey"""
)
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(closed, "l_orderkey", "left_anti").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("orphans"))


@QUERIES.add(
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (
      SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 3)"""
)
def semi_multi_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("n")).where("n > 3")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(many, "o_orderkey", "left_semi")


@QUERIES.add(
    """
    SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS only_supplier, count(DISTINCT l_orderkey) AS n_orders,
      CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS needs_review FROM lineitem GROUP BY l_partkey"""
)
def single_value_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.when(F.countDistinct("l_suppkey") == 1, F.min("l_suppkey")).alias("only_supplier"), F.countDistinct("l_orderkey").alias("n_orders"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("needs_review")
    )


@QUERIES.add(
    """
    SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS evidence, CAST(min(CASE l_linestatus WHEN 'O' THEN 0.9 ELSE 0.6 END) AS DOUBLE) AS confidence
    FROM lineitem GROUP BY l_suppkey, l_returnflag"""
)
def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("l_linestatus") == "O", 0.9).otherwise(0.6)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.countDistinct("l_orderkey").alias("evidence"), F.round(F.min(grade), 6).alias("confidence"))


@QUERIES.add(
    """
    SELECT c_custkey, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_open, coalesce(d.n, 0) AS n_lines
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) d ON d.o_custkey = c_custkey"""
)
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several counts of children: lines are counted per order before the join, so no order is repeated."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines")
    )
    return table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0)


@QUERIES.add(
    """
    SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open,
      CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_discounted, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_returnflag"""
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.countDistinct("l_suppkey").alias("n_suppliers")
    )


@QUERIES.add(
    """
    SELECT n_name, count(c_custkey) AS n_rows, CAST(coalesce(sum(length(c_name)), 0) AS BIGINT) AS n_chars FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY n_name"""
)
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("c_name")).alias("n_chars"))
    return table(spark, sf_dir, "nation").join(per, "n_nationkey", "left").select("n_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@QUERIES.add(
    """
    WITH n AS (SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS node, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, n_nationkey)
    SELECT 2 AS level, n_regionkey, node, n FROM n UNION ALL SELECT 1, n_regionkey, NULL, CAST(sum(n) AS BIGINT) FROM n GROUP BY n_regionkey"""
)
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return graph.tree_rollup(customers, table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")


@QUERIES.add(
    """
    SELECT o_custkey, l_suppkey, count(*) AS paths, count(DISTINCT l_orderkey) AS middles FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def two_hop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return graph.two_hops(first, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "o_custkey", "l_orderkey", "l_suppkey")


@QUERIES.add(
    """
    WITH r AS (SELECT l_returnflag, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS k, sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|' || l_linestatus) AS h FROM lineitem),
    b AS (SELECT l_returnflag, substr(sha256(k), 1, 2) AS bucket, count(*) AS n, min(k) AS low, max(k) AS high, sha256(string_agg(h, chr(10) ORDER BY k, h) || chr(10)) AS d FROM r GROUP BY ALL)
    SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS row_count, min(low) AS min_key, max(high) AS max_key, sha256(string_agg(d, chr(10) ORDER BY bucket) || chr(10)) AS checksum FROM b GROUP BY l_returnflag"""
)
def partition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_linestatus")
    return relational.manifest(table(spark, sf_dir, "lineitem"), "l_returnflag", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), payload)


@QUERIES.add(
    """
    SELECT 'orders_have_customer' AS name, count(*) = 0 AS passed, CAST(0 AS BIGINT) AS expected, count(*) AS actual FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lines_have_order', count(*) = 0, CAST(0 AS BIGINT), count(*) FROM lineitem l LEFT JOIN orders o ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
    UNION ALL SELECT 'line_key_unique', count(*) = 0, CAST(0 AS BIGINT), count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'status_known', count(*) = 0, CAST(0 AS BIGINT), count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')"""
)
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return quality.gates(
        quality.gate("orders_have_customer", orders.join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")),
        quality.gate("lines_have_order", lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")),
        quality.gate("line_key_unique", lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
        quality.gate("status_known", orders.where(~F.col("o_orderstatus").isin("F", "O", "P"))),
    )


@QUERIES.add(
    """
    SELECT 'text' AS field, count(*) AS total, count(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 END) AS filled, round(count(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 END) / count(*), 6) AS ratio,
      round(count(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 END) / count(*), 6) >= 0.9 AS passed FROM documents
    UNION ALL SELECT 'lang', count(*), count(CASE WHEN trim(coalesce(lang, '')) <> '' THEN 1 END), round(count(CASE WHEN trim(coalesce(lang, '')) <> '' THEN 1 END) / count(*), 6), round(count(CASE WHEN trim(coalesce(lang, '')) <> '' THEN 1 END) / count(*), 6) >= 0.9 FROM documents
    UNION ALL SELECT 'source', count(*), count(CASE WHEN trim(coalesce(source, '')) <> '' THEN 1 END), round(count(CASE WHEN trim(coalesce(source, '')) <> '' THEN 1 END) / count(*), 6), round(count(CASE WHEN trim(coalesce(source, '')) <> '' THEN 1 END) / count(*), 6) >= 0.9 FROM documents"""
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(table(spark, sf_dir, "documents"), ["text", "lang", "source"], 0.9)


@QUERIES.add(
    """
    WITH c AS (SELECT d.source, l.toxic, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL),
    m AS (SELECT source, sum(n) AS n FROM c GROUP BY source)
    SELECT CAST((SELECT sum(n * (n - 1) // 2) FROM m) AS BIGINT) AS merged_pairs, CAST((SELECT sum(n * (n - 1) // 2) FROM c) AS BIGINT) AS right_pairs,
      round((SELECT sum(n * (n - 1) // 2) FROM c) / (SELECT sum(n * (n - 1) // 2) FROM m), 6) AS precision"""
)
def pair_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return quality.pair_counts(rated, "source", "toxic")


@QUERIES.add(
    """
    WITH e AS (SELECT DISTINCT toxic AS part, doc_id FROM labels WHERE quality = 1), p AS (SELECT DISTINCT toxic AS part, l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE n_chars >= 500)
    SELECT part, count(e.doc_id) AS expected, count(p.doc_id) AS predicted, count(CASE WHEN e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 1 END) AS matched,
      round(count(CASE WHEN e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 1 END) / count(p.doc_id), 6) AS precision,
      round(count(CASE WHEN e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 1 END) / count(e.doc_id), 6) AS recall
    FROM e FULL JOIN p USING (part, doc_id) GROUP BY part"""
)
def partition_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("part", F.col("toxic"))
    long = table(spark, sf_dir, "documents").where("n_chars >= 500").select("doc_id")
    return quality.partition_metrics(labels.where("quality = 1"), labels.join(long, "doc_id"), "part", "doc_id")


@QUERIES.add(
    """
    SELECT s_suppkey, reason FROM (SELECT s_suppkey, CASE WHEN s_acctbal IS NULL OR s_acctbal < 0 THEN 'negative_balance' WHEN n_name IS NULL OR n_regionkey = 0 THEN 'region_excluded' WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 600) THEN 'already_shown' END AS reason
      FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)"""
)
def authority_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing reason of each supplier: the null is rejected, the order of the reasons counts."""
    busy = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n")).where("n > 600").withColumn("shown", F.lit(True))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    rows = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left").join(busy, "s_suppkey", "left")
    reason = relational.first_reason([("negative_balance", F.col("s_acctbal") < 0), ("region_excluded", F.col("n_regionkey") == 0), ("already_shown", F.coalesce("shown", F.lit(False)))])
    return rows.select("s_suppkey", reason.alias("reason"))


@QUERIES.add("""SELECT p_partkey, p_brand FROM part WHERE coalesce(p_size IN (1, 5, 9), true) AND coalesce(nullif(p_brand, 'Brand#11') IN ('Brand#12', 'Brand#13'), true)""")
def payload_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unknown is kept: a brand that counts as unknown passes the wish for others."""
    brand = F.nullif(F.col("p_brand"), F.lit("Brand#11"))
    return table(spark, sf_dir, "part").where(relational.three_valued(F.col("p_size"), [1, 5, 9]) & relational.three_valued(brand, ["Brand#12", "Brand#13"])).select("p_partkey", "p_brand")


@QUERIES.add(
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@QUERIES.add(
    """
    SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NOT NULL THEN 'number' WHEN b.s_suppkey IS NOT NULL THEN 'nation' ELSE 'none' END AS method
    FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey AND a.s_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) b ON b.s_nationkey = c_nationkey"""
)
def first_match_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    exact = suppliers.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("by_number"))
    nation = suppliers.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("by_nation"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(exact, ["c_custkey", "c_nationkey"], "left").join(nation, "c_nationkey", "left")
    method = F.when(F.col("by_number").isNotNull(), "number").when(F.col("by_nation").isNotNull(), "nation").otherwise("none")
    return rows.select("c_custkey", F.coalesce("by_number", "by_nation").alias("s_suppkey"), method.alias("method"))


@QUERIES.add(
    """
    SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (
      SELECT *, row_number() OVER w AS rn, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    WHERE rn <= 5 AND (rn = 1 OR s <= 400000)"""
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.within_budget(rows, ["o_custkey"], [F.col("o_orderkey")], F.col("o_totalprice"), 400000, 5).withColumn("o_totalprice", F.round("o_totalprice", 2))


@QUERIES.add(
    """
    SELECT doc_id, lang, source, turn FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents)
    ORDER BY turn, lang, source LIMIT 100"""
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return relational.round_robin(rows, ["lang", "source"], F.struct(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), "doc_id"), 100)


@QUERIES.add("""SELECT doc_id, lang FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@QUERIES.add(
    """
    WITH RECURSIVE up(child, parent) AS (SELECT n_nationkey + 100, n_regionkey + 1000 FROM nation UNION SELECT n_regionkey + 1000, 9999 FROM nation),
    r(child, parent, d) AS (SELECT child, parent, 1 FROM up UNION ALL SELECT r.child, up.parent, d + 1 FROM r JOIN up ON r.parent = up.child WHERE d < 10)
    SELECT DISTINCT child, parent FROM r"""
)
def recursive_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    low = nation.select((F.col("n_nationkey") + 100).alias("child"), (F.col("n_regionkey") + 1000).alias("parent"))
    high = nation.select((F.col("n_regionkey") + 1000).alias("child"), F.lit(9999).alias("parent")).distinct()
    return graph.closure(low.union(high))


@QUERIES.add(
    """
    WITH RECURSIVE e(child, parent) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation),
    r(child, parent, d) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT r.child, e.parent, d + 1 FROM r JOIN e ON r.parent = e.child WHERE d < 30)
    SELECT DISTINCT e.child, e.parent FROM e JOIN r ON r.child = e.parent AND r.parent = e.child"""
)
def dag_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("parent"))
    return graph.cycle_edges(edges)


@QUERIES.add(
    """
    WITH RECURSIVE m(id, "into") AS (SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0),
    r(id, final, d) AS (SELECT id, "into", 1 FROM m UNION ALL SELECT r.id, m."into", d + 1 FROM r JOIN m ON r.final = m.id)
    SELECT id, final FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS rn FROM r) WHERE rn = 1"""
)
def merge_chain_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("id"), F.expr("cast(n_nationkey div 2 as int)").alias("into"))
    return graph.resolve_merges(merges)


@QUERIES.add(
    """
    SELECT side, n FROM (SELECT 'l_orderkey' AS side, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))"""
)
def unmatched_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    return graph.unmatched_endpoints(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), nodes, ["l_orderkey", "l_suppkey"], "o_orderkey")


@QUERIES.add(
    """
    WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), x AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT k, CAST(2 AS BIGINT) AS n_sources, count(DISTINCT v) > 1 AS mismatch FROM x WHERE k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) GROUP BY k"""
)
def release_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return quality.reconcile({"catalog": a, "index": b}, "k", "v")


@QUERIES.add(
    """
    WITH b AS (SELECT o_orderkey AS k, 'old' AS v FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT o_orderkey AS k, 'new' AS v FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT coalesce(n.k, b.k) AS k, coalesce(n.v, b.v) AS v FROM b FULL JOIN n ON b.k = n.k"""
)
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"))
    new = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return relational.upsert(old, new, ["k"])


@QUERIES.add("""SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 64) AS BIGINT) AS chunk FROM customer""")
def fixed_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 64 ids in order: ranks come from counts of key ranges, in levels, not from one sorted task."""
    ids = table(spark, sf_dir, "customer").select("c_custkey")
    return ordering.global_rank(ids, "c_custkey").select("c_custkey", F.floor(F.col("rank") / 64).alias("chunk"))

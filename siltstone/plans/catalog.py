"""Queries of catalogue upkeep, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import cosine
from siltstone.operators import catalog, relational
from siltstone.plans.registry import Registry, table

QUERIES = Registry()


@QUERIES.add(
    """
    SELECT c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (
      SELECT o_custkey, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey AND rn = 1"""
)
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("version"), F.col("o_orderkey").alias("set_at"), F.col("o_orderpriority").alias("value"), (F.col("o_orderstatus") == "P").alias("active"))
    return catalog.with_overrides(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"], "c_mktsegment")


@QUERIES.add("SELECT o_custkey, CAST(count(*) + 1 AS BIGINT) AS next_version FROM orders GROUP BY o_custkey")
def next_override_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(relational.Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return catalog.next_versions(table(spark, sf_dir, "orders").select("o_custkey", n.alias("version")), ["o_custkey"])


@QUERIES.add(
    """
    WITH y AS (SELECT max(year(o_orderdate)) AS y FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE year(o_orderdate) < (SELECT y FROM y))
    SELECT o_custkey, o_orderkey, o_orderstatus, false AS active FROM p WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = (SELECT y FROM y))"""
)
def inactive_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in the last year, by their latest earlier one."""
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    last = orders.agg(F.max("y").alias("last"))
    dated = orders.crossJoin(F.broadcast(last))  # one row
    return catalog.tombstones(dated.where("y < last"), dated.where("y = last"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@QUERIES.add("SELECT lower(p_type) AS alias_key, count(DISTINCT p_brand) AS n_topics FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def alias_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ambiguous_aliases(table(spark, sf_dir, "part"), "p_type", "p_brand")


@QUERIES.add(
    """
    WITH a AS (SELECT lower(p_name) AS k, min(p_partkey) AS t FROM part WHERE p_size <= 25 GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), c AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS t FROM part WHERE p_size > 10)
    SELECT p.p_partkey AS concept_id, coalesce(a.t, c.t) AS topic_id, CASE WHEN a.t IS NOT NULL THEN 'alias' WHEN c.t IS NOT NULL THEN 'semantic' ELSE 'provisional' END AS method
    FROM part p LEFT JOIN a ON a.k = lower(p.p_name) LEFT JOIN (SELECT p_partkey, min(t) AS t FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS t FROM part) WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1) c ON c.p_partkey = p.p_partkey"""
)
def alias_or_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    aliases = part.where("p_size <= 25").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("topic_id"))
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("topic_id"))
    choices = part.where("p_size > 10").join(first, "p_brand").select(F.col("p_partkey").alias("concept_id"), "topic_id")
    return catalog.match_aliases(part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name")), aliases, choices)


@QUERIES.add(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS kind, CASE WHEN l_linestatus = 'O' THEN 'primary' ELSE 'related' END AS relation FROM lineitem),
    w AS (SELECT *, sum(CASE WHEN relation = 'primary' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS n FROM l)
    SELECT CASE WHEN NOT ((kind = 'N' AND relation IN ('primary', 'related')) OR (kind = 'A' AND relation = 'related')) OR (relation = 'primary' AND n > 1) THEN 'review' ELSE 'approved' END AS status, count(*) AS n_links FROM w GROUP BY 1"""
)
def topic_link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "O", "primary").otherwise("related").alias("relation"), F.lit("alias").alias("method"))
    return catalog.link_status(links, "l_orderkey", {"N": ["primary", "related"], "A": ["related"]}).groupBy("status").agg(F.count(F.lit(1)).alias("n_links"))


@QUERIES.add(
    """
    WITH a AS (SELECT source AS q, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT source AS q, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
    u AS (SELECT *, 'long' AS e FROM a WHERE rank <= 10 UNION ALL SELECT *, 'old' FROM b WHERE rank <= 10)
    SELECT q, doc_id, CAST(min(rank) AS INTEGER) AS best_rank, string_agg(e || ':' || rank, ',' ORDER BY e || ':' || rank) AS appearances FROM u GROUP BY q, doc_id"""
)
def pool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("q"), "doc_id", "n_chars")
    long = relational.top_per_key(docs, ["q"], [F.desc("n_chars"), F.col("doc_id")], 10)
    old = relational.top_per_key(docs, ["q"], [F.col("doc_id")], 10)
    return catalog.pool({"long": long, "old": old}, "q", "doc_id")


@QUERIES.add(
    """
    WITH e AS (SELECT vec_id // 2 AS s, vec_id % 2 AS r, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT count(*) AS sentinels, round(min(c), 6) AS least, round(avg(c), 6) AS mean FROM (SELECT list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b USING (s) WHERE a.r = 0 AND b.r = 1)"""
)
def sentinel_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as two runs of one sentinel."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("s"), (F.col("vec_id") % 2).alias("r"), "embedding")
    a, b = e.where("r = 0").select("s", F.col("embedding").alias("x")), e.where("r = 1").select("s", F.col("embedding").alias("y"))
    c = a.join(b, "s").select(cosine(F.col("x"), F.col("y")).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("sentinels"), F.round(F.min("c"), 6).alias("least"), F.round(F.avg("c"), 6).alias("mean"))


@QUERIES.add("SELECT doc_id, needle FROM documents JOIN (VALUES ('license'), ('copyright'), ('version')) t(needle) ON contains(lower(text), needle)")
def keyword_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["license", "copyright", "version"]).drop("text")


@QUERIES.add(
    """
    SELECT doc_id, concat_ws(',', CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, '|') THEN 'tabular' END) AS strata FROM documents"""
)
def gold_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"long": F.col("n_chars") > 5000, "foreign": F.col("lang") != "en", "tabular": F.contains("text", F.lit("|"))}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(catalog.strata(flags), ",").alias("strata"))


@QUERIES.add(
    """
    WITH s AS (SELECT p_brand AS q, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_size > 40), r AS (SELECT p_brand AS q, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_size > 20),
    u AS (SELECT q, p_partkey, rank, 0 AS tier FROM s UNION ALL SELECT q, p_partkey, rank, 1 FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM s))
    SELECT q, p_partkey, tier, CAST(row_number() OVER (PARTITION BY q ORDER BY tier, rank, p_partkey) AS INTEGER) AS rank FROM u"""
)
def relaxed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("q"), "p_partkey", "p_retailprice", "p_size")
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    ranked = lambda least: relational.top_per_key(part.where(F.col("p_size") > least), ["q"], order, 1 << 30)
    return catalog.preferred(ranked(40), ranked(20), "q", "p_partkey")


@QUERIES.add(
    """
    SELECT count(*) AS profiles, count(CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 1 END) AS hits, count(CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM labels) THEN 1 END) AS misses FROM documents d"""
)
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    hits, misses = catalog.cached(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])
    both = hits.select(F.lit(1).alias("hit")).unionByName(misses.select(F.lit(0).alias("hit")))
    return both.agg(F.count(F.lit(1)).alias("profiles"), F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


@QUERIES.add("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS has_k, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = catalog.iso_utc(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").isNotNull().alias("has_k"), F.unix_timestamp(at).alias("at"))


@QUERIES.add(
    """
    WITH b AS (SELECT o_orderpriority AS build, o_orderstatus AS status, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, max(epoch(o_orderdate)) AS newest FROM orders GROUP BY ALL)
    SELECT build, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(sum(total), 2) AS total, CAST(sum(CASE WHEN status = 'O' THEN n_rows ELSE 0 END) AS BIGINT) AS prunable, CAST(max(newest) AS BIGINT) AS newest FROM b GROUP BY build"""
)
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning rows of open builds would free, per build."""
    newest = F.max(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("build")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("prunable"), newest.alias("newest")
    )

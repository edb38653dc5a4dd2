"""Queries of scoring, plan changes and integrity gates over the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import catalogue, export, planning, recommend, relational, retrieval
from siltstone.plans import texts
from siltstone.plans.registry import Registry, table

QUERIES = Registry()


@QUERIES.add(
    """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'orcid:0000-000X-0000-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'google_scholar:u' || c_custkey END AS identity FROM customer"""
)
def external_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities in profile links of two services, among links that only look like them."""
    key = F.col("c_custkey")
    link = (
        F.when(key % 4 == 0, F.concat(F.lit("https://orcid.org/0000-000x-0000-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("/")))
        .when(key % 4 == 1, F.concat(F.lit("https://scholar.google.com/citations?hl=en&user=u"), key))
        .when(key % 4 == 2, F.concat(F.lit("https://orcid.org/0000-0000-"), key))
        .otherwise(F.concat(F.lit("https://scholar.google.org/citations?user=u"), key))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", urls.external_identity(link).alias("identity"))


@QUERIES.add(f"SELECT count(*) AS queries, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(recall_at_20), 6) AS recall_at_20, round(avg(CAST(none_in_ten AS INTEGER)), 6) AS none_in_ten FROM ({texts.QUERIES.sql['ndcg_at_10']})")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the retrieval metrics over queries, each query counting the same."""
    return retrieval.macro(texts.ndcg_at_10(spark, sf_dir))


@QUERIES.add(
    """
    WITH r AS (SELECT p_brand AS query_id, p_partkey AS entity_id, least(p_retailprice / 2000, 1.0) AS semantic, lower(p_name) AS s, lower(p_type) AS y, p_partkey % 7 > 0 AS told, p_partkey % 3 = 0 AS topical, p_partkey AS k, p_size AS z FROM part),
    t AS (SELECT *, (contains(CASE WHEN topical THEN y || ' ' ELSE '' END || s, 'steel')::INT + contains(CASE WHEN topical THEN y || ' ' ELSE '' END || s, 'large')::INT) / 2.0::DOUBLE AS topic,
      contains(CASE WHEN told THEN y || ' ' ELSE '' END || s, 'small')::INT * 1.0::DOUBLE AS fit, (CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0 END + CASE WHEN k % 5 = 0 THEN 0.5::DOUBLE ELSE 0.0 END) * CASE WHEN k % 4 = 0 THEN 0.7::DOUBLE ELSE 1.0 END AS eligible,
      k % 6 + k % 3 AS evidence_count, (told::INT + 1 + topical::INT + (k % 2 > 0)::INT + (k % 3 > 0)::INT) / 5.0::DOUBLE AS filled, CASE WHEN z % 2 = 0 THEN least(0.15::DOUBLE, 0.05::DOUBLE * (z % 5 IN (1, 2))::INT) ELSE 0.0 END AS boost,
      (contains(CASE WHEN told THEN y || ' ' ELSE '' END || s || CASE WHEN topical THEN ' ' || y ELSE '' END, 'steel')::INT + contains(CASE WHEN told THEN y || ' ' ELSE '' END || s || CASE WHEN topical THEN ' ' || y ELSE '' END, 'large')::INT) / 2.0::DOUBLE AS direction FROM r),
    w AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.50::DOUBLE * semantic + 0.18::DOUBLE * topic + 0.12::DOUBLE * fit + 0.08::DOUBLE * eligible + 0.08::DOUBLE * least(1.0::DOUBLE, evidence_count / 5.0::DOUBLE) + 0.04::DOUBLE * filled + boost)) AS raw FROM t),
    c AS (SELECT *, round(CASE WHEN max(direction) OVER (PARTITION BY query_id) > 0 AND direction <= 0 THEN least(raw, 0.34::DOUBLE) ELSE raw END, 6) AS score FROM w)
    SELECT query_id, entity_id, score, CASE WHEN score >= 0.75 THEN 'excellent' WHEN score >= 0.55 THEN 'strong' WHEN score >= 0.35 THEN 'possible' ELSE 'weak' END AS level, direction, CAST(evidence_count AS BIGINT) AS evidence_count,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, semantic DESC, evidence_count DESC, entity_id) AS INTEGER) AS rank FROM c"""
)
def reranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates of a query for each brand: six components, a boost, a cap where a candidate lacks the direction that others have."""
    key, words = F.col("p_partkey"), lambda *ws: F.array(*map(F.lit, ws)).cast("array<string>")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("query_id"), key.alias("entity_id"), F.least(F.col("p_retailprice") / 2000, F.lit(1.0)).alias("semantic"), words("steel", "LARGE").alias("query_terms"), words("small").alias("interests"),
        F.when(F.col("p_size") % 2 == 0, words("t1", "t2")).otherwise(none).alias("anchor_topics"), F.array(F.concat(F.lit("t"), F.col("p_size") % 5)).alias("topic_ids"), F.when(key % 7 > 0, F.col("p_type")).alias("summary"),
        F.array("p_name").alias("statements"), F.when(key % 3 == 0, F.array(F.lower("p_type"))).otherwise(none).alias("topics"), F.when(key % 2 == 0, "confirmed").otherwise("unknown").alias("master"), F.when(key % 5 == 0, "confirmed").alias("phd"),
        F.when(key % 4 == 0, "review").otherwise("included").alias("role_status"), (key % 6).alias("n_refs"), (key % 3).alias("n_urls"), (key % 2).alias("n_publications"),
    )
    return recommend.rerank(rows)


@QUERIES.add(
    """
    WITH r AS (SELECT p_partkey AS k, lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_type || CASE WHEN p_partkey % 4 = 0 THEN ' 论文' ELSE '' END) AS blob, lower(p_type) AS y, p_size / 50.0::DOUBLE AS recall, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 12 END AS h FROM part)
    SELECT p_partkey, CAST(interest AS DOUBLE) AS interest, CAST(eligibility_score AS DOUBLE) AS eligibility_score, CAST(effort AS DOUBLE) AS effort, CAST(timeline AS DOUBLE) AS timeline, CAST(goal_score AS DOUBLE) AS goal_score, CAST(provenance AS DOUBLE) AS provenance FROM (
    SELECT k AS p_partkey, CASE WHEN k % 2 = 0 THEN least(recall, 1.0) ELSE least(1.0::DOUBLE, greatest(recall, contains(blob, 'steel')::INT * 1.0::DOUBLE)) END AS interest,
      CASE WHEN k % 3 > 0 THEN CASE WHEN k % 5 > 0 THEN 0.65 ELSE 0.45 END WHEN contains(y, 'large') THEN 1.0 WHEN k % 5 > 0 THEN 0.6 ELSE 0.35 END AS eligibility_score,
      CASE WHEN h IS NULL THEN CASE WHEN k % 4 = 0 THEN 0.55 ELSE 0.7 END WHEN k % 4 = 0 THEN CASE WHEN h >= 10 THEN 1.0 WHEN h >= 5 THEN 0.72 ELSE 0.42 END WHEN h >= 3 THEN 0.9 ELSE 0.62 END AS effort,
      CASE WHEN k % 4 IN (0, 3) THEN CASE WHEN k % 3 > 0 THEN 0.65 ELSE 0.45 END WHEN k % 4 = 1 AND k % 3 > 0 THEN 1.0 WHEN k % 3 > 0 THEN 0.55 ELSE 0.35 END AS timeline,
      CASE WHEN k % 5 = 0 THEN 0.65 WHEN k % 5 < 3 AND k % 4 = 0 THEN 1.0 ELSE 0.58 END AS goal_score, CASE WHEN k % 3 = 0 THEN 0.2 WHEN k % 2 = 0 THEN 1.0 ELSE 0.82 END AS provenance FROM r)"""
)
def competition_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as competitions: what each is worth by interest, eligibility, effort, time, goal and provenance."""
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    wish = F.when(key % 4 == 1, "Spring").when(key % 4 == 2, "autumn").when(key % 4 == 3, "")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.array("p_type").alias("tags"), none.alias("focus"), none.alias("risks"), F.when(key % 2 == 1, F.array(F.lit("Steel"))).otherwise(none).alias("interests"),
        F.when(key % 3 == 0, F.array(F.lit("large"), F.lit(""))).otherwise(none).alias("hints"), F.concat("p_type", F.when(key % 4 == 0, " 论文").otherwise("")).alias("summary"), F.when(key % 5 > 0, "open to all").otherwise("").alias("eligibility"),
        F.when(key % 3 > 0, "in spring").otherwise("").alias("schedule"), F.when(key % 11 > 0, key % 12).alias("weekly_hours"), wish.alias("time_window"), F.when(key % 5 == 0, None).when(key % 5 < 3, "research").otherwise("other").alias("goal"),
        (F.col("p_size") / 50).alias("recall"), (key % 3).alias("n_refs"), (key % 2 == 0).alias("in_catalog"),
    )
    return recommend.competition_components(rows).select("p_partkey", "interest", "eligibility_score", "effort", "timeline", "goal_score", "provenance")


@QUERIES.add(
    """
    WITH t AS (SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS id, max(struct_pack(p := CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END, m := l_linestatus = 'O')) AS t FROM lineitem GROUP BY 1, 2),
    o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, o_orderkey % 40 AS n FROM orders), c AS (SELECT o.*, t.t FROM o LEFT JOIN t ON t.k = o.k AND t.id = CASE o.k % 5 WHEN 0 THEN '1' WHEN 2 THEN '2' END),
    r AS (SELECT k, CASE WHEN k % 5 <> 4 AND k % 4 = 0 THEN 'missing_required_fields'
      WHEN k % 5 = 0 THEN CASE WHEN t IS NULL THEN 'target_task_not_found' WHEN k % 7 = 0 THEN 'date_out_of_range' WHEN d + CAST(n AS INTEGER) >= DATE '1995-06-01' AND d + CAST(n AS INTEGER) >= CASE WHEN t.p = 'a' THEN d ELSE d + 11 END AND d + CAST(n AS INTEGER) <= CASE WHEN t.p = 'a' THEN d + 10 ELSE d + 30 END THEN NULL ELSE 'date_out_of_range' END
      WHEN k % 5 = 1 THEN CASE WHEN k % 6 = 0 THEN 'target_phase_not_found' WHEN k % 9 = 0 THEN 'invalid_add_task_fields' WHEN d + CAST(n AS INTEGER) >= DATE '1995-06-01' AND n BETWEEN 11 AND 30 THEN NULL ELSE 'date_out_of_range' END
      WHEN k % 5 = 2 THEN CASE WHEN t IS NULL THEN 'target_task_not_found' WHEN t.m THEN 'required_task_delete_forbidden' END
      WHEN k % 5 = 3 THEN CASE WHEN k % 8 = 1 THEN 'phase_schedule_invalid' WHEN d < DATE '1995-06-01' OR n < 5 OR s = 'P' THEN 'phase_schedule_invalid' END
      WHEN k % 3 = 0 THEN 'invalid_advice_fields' END AS code FROM c)
    SELECT k AS card_id, CASE WHEN code IS NULL THEN 'passed' ELSE 'rejected' END AS status, code FROM r"""
)
def change_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for the plan that each order is, of two phases and with its lines for tasks."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    later = lambda n: F.date_add(day, n)
    plans = orders.select(key.alias("plan_id"), F.lit(None).cast("string").alias("time_model"), F.lit(None).cast("date").alias("target_date"), (F.col("o_orderstatus") != "P").alias("valid"))
    each = F.array(F.struct(F.lit("a").alias("phase_id"), F.lit("warm").alias("phase_key"), day.alias("start"), later(10).alias("end")), F.struct(F.lit("b").alias("phase_id"), F.lit("main").alias("phase_key"), later(11).alias("start"), later(30).alias("end")))
    phases = orders.select(key.alias("plan_id"), F.explode(each).alias("p")).select("plan_id", "p.*")
    lines = table(spark, sf_dir, "lineitem")
    tasks = lines.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").cast("string").alias("task_id"), F.when(F.col("l_returnflag") == "R", "a").otherwise("b").alias("phase_id"), (F.col("l_linestatus") == "O").alias("mandatory"))
    kinds = F.array(*map(F.lit, ("move_task", "add_task", "delete_task", "reschedule_phase", "append_advice")))
    kind, moved = F.get(kinds, (key % 5).cast("int")), later((key % 40).cast("int"))
    span = F.array(F.struct(F.lit("main").alias("phase"), day.alias("start"), later((key % 40 - 5).cast("int")).alias("end")))
    cards = orders.select(
        key.alias("card_id"), key.alias("plan_id"), kind.alias("type"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("code"), (key % 4).alias("n_sources"), F.when(key % 5 == 0, "1").when(key % 5 == 2, "2").alias("target_task"),
        F.when(key % 5 == 1, F.when(key % 6 == 0, "none").otherwise("main")).alias("target_phase"), F.when(key % 7 > 0, moved).alias("new_date"), (key % 9 > 0).alias("new_task"), moved.alias("due_date"), F.when(key % 8 != 1, span).alias("schedule"),
        F.when(key % 3 > 0, "advice").otherwise(" ").alias("advice"),
    )
    return planning.change_cards(cards, plans, phases, tasks, F.lit("1995-06-01").cast("date"))


@QUERIES.add(
    """
    WITH g(name, expected, actual) AS (SELECT 'catalog_graph_manifest', '0', 1 UNION ALL SELECT 'catalog_graph_profile_hash', '0', count(*) FROM customer WHERE c_custkey % 50 < 2
      UNION ALL SELECT 'curation_gold', '0', count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(CASE WHEN p_size > 2 THEN 1 END) / count(*) < 0.99) UNION ALL SELECT 'graph_gold', '0', 1
      UNION ALL SELECT 'vector_count', '0', (SELECT count(*) FROM customer WHERE c_custkey % 9 > 0) - (SELECT count(*) FROM customer WHERE c_custkey % 3 > 0)
      UNION ALL SELECT 'vector_ids', '0', count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 9 > 0 UNION ALL SELECT 'vector_payload', '0', count(*) FROM customer WHERE c_custkey % 9 > 0 AND c_custkey % 13 = 0
      UNION ALL SELECT 'promotion_pointers', '1', 2 UNION ALL SELECT 'readiness', '0', 0 UNION ALL SELECT 'index_integrity', '0', 0)
    SELECT name, expected = CAST(actual AS VARCHAR) AS passed, expected, CAST(actual AS VARCHAR) AS actual FROM g"""
)
def integrity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on a release over the star schema, with faults planted so that most of them fail."""
    nations, customers, key = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = export.node_rows(nations, "Nation", "n_nationkey", ["n_name"]).unionByName(export.node_rows(table(spark, sf_dir, "region"), "Region", "r_regionkey", ["r_name"]))
    changed = rows.withColumn("payload", F.when(F.col("row_key") == "Nation:3", "{}").otherwise(F.col("payload")))
    stored = relational.manifest(rows, "partition", F.col("row_key"), F.col("payload"))
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256).alias("profile_hash")
    profiles = customers.select(key.alias("entity_id"), sha(key))
    cached = customers.where(key % 50 != 0).select(key.alias("entity_id"), sha(F.when(key % 50 == 1, -key).otherwise(key)))
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.avg((F.col("p_size") > 2).cast("double")).alias("value")).withColumn("least", F.lit(0.99))
    fixed = lambda *ms: spark.createDataFrame(list(ms), "metric string, value double, least double")
    payload: Column = F.when(key % 13 == 0, '{"email":"x"}').otherwise('{"name":"x"}')
    return export.integrity_gates(
        changed, stored, profiles, cached, {"curation_gold": brands, "graph_gold": fixed(("precision", 0.98, 0.98), ("provenance", None, 1.0))},
        customers.where(key % 3 > 0).select(key.alias("entity_id")), customers.where(key % 9 > 0).select(key.alias("point_id"), payload.alias("payload")), ["email", "phone"],
        spark.createDataFrame([("graph", "b1"), ("vectors", "b2")], "name string, version string"), fixed(("coverage", 1.0, 0.9)), rows.limit(0),
    )


def _build(spark: SparkSession, sf_dir: str) -> catalogue.Build:
    """The star schema as a catalogue: customers as professors, orders as observations, lines as mentions, priorities as statements."""
    nations, customers, orders, lines = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    text, none = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string")), F.lit(None).cast("string")
    nation, key, order = F.col("c_nationkey"), F.col("c_custkey"), F.col("o_orderkey")
    unit = F.concat(F.lit("g"), nation, F.lit("-"), F.col("c_mktsegment"))
    grade = F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "O", "legacy_merged").otherwise("other")
    seen = orders.select(text("o", order).alias("id"), text("e", F.col("o_custkey")).alias("entity_id"), F.when(order % 7 > 0, text("d", order % 500)).alias("document_id"), grade.alias("grade"), (F.col("o_orderpriority") != "5-LOW").alias("active"))
    first = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))
    statement = F.concat(F.lit("s"), "o_custkey", F.lit("-"), "o_orderpriority")
    mentioned = lines.select(text("o", F.col("l_orderkey")).alias("observation_id"), "l_partkey", "l_shipdate", "l_discount", "l_returnflag").join(orders.select(text("o", order).alias("observation_id"), "o_custkey"), "observation_id")
    topic = text("t", F.col("p_size"))
    return catalogue.Build("b", {
        "universities": nations.select(text("u", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), none.alias("city")),
        "org_units": customers.select(unit.alias("id"), text("u", nation).alias("university_id"), F.col("c_mktsegment").alias("name"), F.lit("school").alias("kind"), none.alias("url")).distinct(),
        "professors": customers.select(text("e", key).alias("id"), F.col("c_name").alias("name"), none.alias("title"), none.alias("title_family"), F.lit("included").alias("role_status"), F.array().cast("array<string>").alias("reasons"), none.alias("master"), none.alias("phd"), (F.col("c_acctbal") >= 0).alias("active")),
        "profiles": customers.where("c_acctbal > 1000").select(text("e", key).alias("id"), F.sha2(F.col("c_name").cast("binary"), 256).alias("profile_hash")),
        "observations": seen,
        "affiliations": orders.join(customers, F.col("o_custkey") == key).select(text("e", key).alias("entity_id"), unit.alias("org_unit_id"), grade.alias("grade")),
        "statements": first.select(statement.alias("id"), text("e", F.col("o_custkey")).alias("entity_id"), text("o", order).alias("observation_id"), F.col("o_orderpriority").alias("raw_text"), F.lit("en").alias("language"), F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("hash")),
        "mentions": mentioned.select(F.concat(F.lit("m"), "o_custkey", F.lit("-"), "l_partkey").alias("id"), text("e", F.col("o_custkey")).alias("entity_id"), "observation_id", F.lit("raw").alias("raw_text"), none.alias("doi"), F.year("l_shipdate").alias("year"), F.col("l_discount").cast("double").alias("confidence"), (F.col("l_returnflag") == "R").alias("needs_review")),
        "documents": spark.range(500).select(text("d", F.col("id")).alias("id"), text("u", F.col("id") % 25).alias("university_id"), none.alias("url"), none.alias("content_hash"), none.alias("title"), none.alias("fetched_at")),
        "topics": table(spark, sf_dir, "part").select(topic.alias("id"), topic.alias("canonical_name"), topic.alias("normalized_name"), F.lit("task").alias("kind"), F.when(F.col("p_size") % 10 > 0, "active").otherwise("retired").alias("status")).distinct(),
        "topic_links": first.select(statement.alias("statement_id"), text("t", F.col("o_custkey") % 50 + 1).alias("topic_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "PRIMARY_TOPIC").when(F.col("o_orderpriority") == "2-HIGH", "USES_METHOD").otherwise("STUDIES").alias("relation"), F.when(F.col("o_orderkey") % 3 > 0, "approved").otherwise("pending").alias("review_status"), F.lit(0.9).alias("confidence"), F.lit("alias").alias("method"), F.lit("p").alias("provenance")),
        "topic_relations": spark.range(1, 50).select(text("t", F.col("id") + 1).alias("child"), text("t", F.col("id")).alias("parent"), F.lit(1.0).alias("confidence"), F.lit("taxonomy").alias("method"), F.lit("r").alias("provenance")),
    })


@QUERIES.add(
    """
    WITH o AS (SELECT *, 'b:e' || o_custkey AS e, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 ELSE 0.5 END AS sure, 'd' || (o_orderkey % 500) AS d FROM orders), a AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0),
    seen AS (SELECT * FROM o WHERE o_orderpriority <> '5-LOW' AND o_custkey IN (SELECT c_custkey FROM a)), doc AS (SELECT * FROM seen WHERE o_orderkey % 7 > 0),
    f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2), s AS (SELECT f.*, 's' || f.o_custkey || '-' || f.o_orderpriority AS s, sure FROM f JOIN o USING (o_orderkey)),
    g AS (SELECT DISTINCT 'g' || c_nationkey || '-' || c_mktsegment AS g, c_nationkey AS n FROM customer), t AS (SELECT DISTINCT p_size FROM part WHERE p_size % 10 > 0), m AS (SELECT o_custkey, l_partkey, l_orderkey, sure, e, 'm' || o_custkey || '-' || l_partkey AS m FROM lineitem JOIN o ON o_orderkey = l_orderkey),
    k AS (SELECT s, 't' || (o_custkey % 50 + 1) AS t, CASE o_orderpriority WHEN '1-URGENT' THEN 'PRIMARY_TOPIC' WHEN '2-HIGH' THEN 'USES_METHOD' ELSE 'STUDIES' END AS r FROM s WHERE o_orderkey % 3 > 0 AND (o_custkey % 50 + 1) IN (SELECT p_size FROM t)),
    x(partition, row_key, n, sure) AS (SELECT 'node:Build', 'b', NULL, NULL UNION ALL SELECT 'node:University', 'u' || n_nationkey, NULL, NULL FROM nation UNION ALL SELECT 'node:OrgUnit', g, NULL, NULL FROM g UNION ALL SELECT 'node:Professor', 'e' || c_custkey, NULL, NULL FROM a
      UNION ALL SELECT 'node:ResearchStatement', s, NULL, NULL FROM s UNION ALL SELECT 'node:Topic', 't' || p_size, NULL, NULL FROM t UNION ALL SELECT DISTINCT 'node:PublicationMention', m, NULL, NULL FROM m UNION ALL SELECT DISTINCT 'node:SourceDocument', d, NULL, NULL FROM doc
      UNION ALL SELECT 'rel:PART_OF', 'b:' || g || '|b:u' || n, 1, 1.0 FROM g UNION ALL SELECT 'rel:AFFILIATED_WITH', e || '|b:g' || c_nationkey || '-' || c_mktsegment, count(*), min(sure) FROM o JOIN customer ON c_custkey = o_custkey GROUP BY ALL
      UNION ALL SELECT 'rel:HAS_RESEARCH_STATEMENT', 'b:e' || o_custkey || '|b:' || s, 1, sure FROM s UNION ALL SELECT 'rel:' || r, 'b:' || s || '|b:' || t, 1, 0.9 FROM k
      UNION ALL SELECT 'rel:SUBTOPIC_OF', 'b:t' || (i + 1) || '|b:t' || i, 1, 1.0 FROM range(1, 50) r(i) WHERE i IN (SELECT p_size FROM t) AND i + 1 IN (SELECT p_size FROM t)
      UNION ALL SELECT 'rel:HAS_PUBLICATION_MENTION', e || '|b:' || m, count(DISTINCT l_orderkey), min(sure) FROM m GROUP BY ALL UNION ALL SELECT 'rel:OBSERVED_IN', e || '|b:' || d, count(*), min(sure) FROM doc GROUP BY ALL
      UNION ALL SELECT 'rel:FROM_UNIVERSITY', 'b:' || d || '|b:u' || (o_orderkey % 500) % 25, count(DISTINCT o_orderkey), 1.0 FROM doc GROUP BY ALL)
    SELECT partition, count(*) AS row_count, min(row_key) AS min_key, max(row_key) AS max_key, CAST(sum(n) AS BIGINT) AS evidence, round(CAST(sum(sure) AS DOUBLE), 4) AS confidence FROM x GROUP BY partition"""
)
def catalogue_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions of a build: rows, least and greatest key, and sums over the relations' payloads."""
    field = lambda name, kind: F.when(F.col("partition").startswith("rel:"), F.get_json_object("payload", f"$.{name}").cast(kind)).alias(name)
    # Least strings are worked out over sorted rows, so the payloads, the widest column, are read before. Decimals add up exactly, whatever the number of rows.
    rows = _build(spark, sf_dir).rows().select("partition", "row_key", field("evidence_count", "long"), field("confidence", "decimal(20,10)"))
    return rows.groupBy("partition").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("row_key").alias("min_key"), F.max("row_key").alias("max_key"), F.sum("evidence_count").alias("evidence"), F.round(F.sum("confidence").cast("double"), 4).alias("confidence")
    )

"""Queries of recommendation answers over documents, ratings, conversations and parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import answers, catalog, quality, relational, retrieval
from siltstone.plans.registry import Registry, table
from siltstone.storage import cut

QUERIES = Registry()


@QUERIES.add(
    """
    WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'more_mentors' WHEN 1 THEN 'same_field' WHEN 2 THEN 'refine_direction' WHEN 3 THEN 'detail_followup' WHEN 4 THEN 'other' WHEN 5 THEN NULL ELSE 'new_search' END AS intent,
      CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || user_id END AS anchor, CASE WHEN user_id % 2 = 0 THEN ['p' || user_id, 'q'] ELSE [] END AS prior FROM events),
    k AS (SELECT *, coalesce(intent, 'new_search') AS asked FROM r), t AS (SELECT *, CASE WHEN asked = 'other' THEN 'new_search' ELSE asked END AS route FROM k)
    SELECT event_id, route, CASE WHEN route = 'more_mentors' THEN array_to_string(prior, ',') ELSE '' END AS excluded, CASE WHEN route IN ('same_field', 'detail_followup') THEN nullif(anchor, '') END AS anchor_used, route = 'refine_direction' AS merges,
      CASE WHEN asked = 'other' THEN 'invalid_intent' WHEN asked = 'detail_followup' AND nullif(anchor, '') IS NULL THEN 'detail_followup_requires_anchor' WHEN asked = 'more_mentors' AND len(prior) = 0 THEN 'more_mentors_requires_prior' WHEN asked = 'same_field' AND nullif(anchor, '') IS NULL THEN 'same_field_requires_anchor' END AS issue,
      CASE WHEN event_id % 3 = 0 THEN 'x' WHEN route IN ('new_search', 'refine_direction') THEN 'y,z' ELSE '' END AS cities FROM t"""
)
def intent_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests with an intent, an anchor and earlier results; and the cities that they filter by."""
    n, u = F.col("event_id") % 7, F.col("user_id")
    intent = F.when(n == 0, "more_mentors").when(n == 1, "same_field").when(n == 2, "refine_direction").when(n == 3, "detail_followup").when(n == 4, "other").when(n == 6, "new_search")
    anchor = F.when(u % 3 == 0, "").when(u % 3 == 1, F.concat(F.lit("a"), u.cast("string")))
    prior = F.when(u % 2 == 0, F.array(F.concat(F.lit("p"), u.cast("string")), F.lit("q"))).otherwise(F.array().cast("array<string>"))
    rows = answers.routed(table(spark, sf_dir, "events").select("event_id", intent.alias("intent"), anchor.alias("anchor"), prior.alias("prior")))
    explicit = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    cities = answers.effective_cities(explicit, F.array(F.lit("y"), F.lit("z")), F.col("route"))
    return rows.select("event_id", "route", F.array_join("excluded", ",").alias("excluded"), "anchor_used", "merges", "issue", F.array_join(cities, ",").alias("cities"))


@QUERIES.add(
    """
    WITH p AS (SELECT *, string_split(p_name, ' ') AS words, CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [lower(string_split(p_name, ' ')[1]), 'zzz'] END AS terms, p_partkey % 9 <> 0 AS there, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 0.5 END AS direction FROM part),
    m AS (SELECT *, CASE WHEN len(terms) > 0 THEN list_filter(words, lambda x: contains(lower(x), terms[1])) ELSE [] END AS t, CASE WHEN len(terms) > 0 AND contains(lower(p_type), terms[1]) THEN [p_type] ELSE [] END AS s, len(terms) > 0 AND direction <= 0 AS nodir FROM p)
    SELECT p_partkey, CASE WHEN there THEN array_to_string(t, '|') ELSE '' END AS topics, CASE WHEN there THEN array_to_string(s, '|') ELSE '' END AS statements, CASE WHEN there THEN nodir OR p_partkey % 6 = 0 ELSE true END AS weak,
      CASE WHEN NOT there THEN 'ProfessorDetail unavailable in ACTIVE build' WHEN nodir THEN 'no direct direction evidence for query terms' WHEN p_partkey % 6 = 0 THEN 'no provenance or source URLs' END AS missing_reason,
      CASE WHEN NOT there THEN '综合匹配信号较高；当前缺少可回溯详情证据' WHEN nodir THEN '未找到与查询方向直接对应的研究证据，仅作为语义近邻参考'
        WHEN len(t) + len(s) = 0 THEN '语义召回匹配，未找到精确方向证据 (score=0.25)' ELSE concat_ws('|', CASE WHEN len(t) > 0 THEN '研究方向匹配: ' || array_to_string(t[1:3], ', ') END, CASE WHEN len(s) > 0 THEN '研究陈述命中: ' || substr(s[1], 1, 60) END) END AS reasons FROM m"""
)
def match_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recommended persons: words of the name are topics, the type is a statement."""
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 5 == 0, none).otherwise(F.array(F.lower(F.get(words, F.lit(0))), F.lit("zzz"))).alias("terms"), words.alias("topics"), F.array("p_type").alias("statements"), none.alias("publications"), F.lit("").alias("summary"),
        none.alias("refs"), F.when(key % 6 == 0, none).otherwise(F.array(F.lit("u"))).alias("source_urls"), F.lit(0.25).alias("score"), F.when(key % 4 == 0, 0.0).otherwise(0.5).alias("direction"), (key % 9 != 0).alias("has_detail"),
    )
    joined = lambda c: F.array_join(c, "|").alias(c)
    out = answers.explained(rows)
    return out.select("p_partkey", F.array_join("matched_topics", "|").alias("topics"), F.array_join("matched_statements", "|").alias("statements"), "weak", "missing_reason", joined("reasons"))


@QUERIES.add(
    """
    WITH h AS (SELECT 'c' || doc_id AS chunk_hash, 1.0::DOUBLE / (doc_id + 1) AS score FROM documents), t AS (SELECT greatest(sum(greatest(score, 0.0)), 1.0) AS total FROM h),
    r AS (SELECT p_partkey AS card_id, 'c' || unnest([p_partkey % 37, p_partkey % 41 + 5]) AS chunk_hash FROM part), s AS (SELECT card_id, least(sum(score) / any_value(total), 1.0) AS source_score FROM r JOIN h USING (chunk_hash), t GROUP BY card_id),
    c AS (SELECT p_partkey AS card_id, p_name AS name, greatest(coalesce(source_score, 0.0), (contains(lower(p_name || ' ' || p_type), 'large')::INT + contains(lower(p_name || ' ' || p_type), 'steel')::INT) / 2.0::DOUBLE) AS score FROM part LEFT JOIN s ON card_id = p_partkey)
    SELECT card_id, name, score FROM c WHERE score > 0 ORDER BY score DESC, name, card_id LIMIT 25"""
)
def competition_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as competition cards: references to ranked chunks, and two terms."""
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("blob"))
    refs = cards.select("card_id", F.explode(F.array(F.col("card_id") % 37, F.col("card_id") % 41 + 5)).alias("n")).select("card_id", F.concat(F.lit("c"), F.col("n").cast("string")).alias("chunk_hash"))
    hits = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_hash"), (F.lit(1.0) / (F.col("doc_id") + 1)).alias("score"))
    return answers.recalled(cards, answers.source_match(refs, hits), ["Large", "steel"], 25)


@QUERIES.add(
    """
    WITH k AS (SELECT p_brand AS brand, arg_min(p_type, p_partkey) FILTER (WHERE contains(lower(p_type), 'steel') OR contains(lower(p_type), 'large')) AS text FROM part GROUP BY p_brand)
    SELECT p.p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'large') OR contains(lower(p_type), 'small') THEN 'size' ELSE 'other' END AS category, substr(k.text, 1, 12) AS first_text FROM part p JOIN k ON k.brand = p.p_brand WHERE k.text IS NOT NULL"""
)
def catalog_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of each part by keywords, and its brand's first text that holds one."""
    parts = table(spark, sf_dir, "part")
    first = answers.first_with_keyword(parts.select(F.col("p_brand").alias("brand"), "p_partkey", F.col("p_type").alias("text")), "brand", "p_partkey", ["Steel", "large"], 12)
    kind = answers.category(F.col("p_type"), [("metal", ["STEEL"]), ("size", ["large", "small"])], "other")
    return parts.select("p_partkey", kind.alias("category"), F.col("p_brand").alias("brand")).join(first, "brand").select("p_partkey", "category", F.col("text").alias("first_text"))


@QUERIES.add(
    """
    SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'uncertain' WHEN quality = 0 OR toxic = 1 THEN 'partial' ELSE 'grounded' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'n1；n2' WHEN toxic = 1 THEN 'check again' END AS notice FROM labels"""
)
def evidence_and_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    refs = F.when(key % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r")))
    statuses = F.array(F.when(F.col("quality") == 0, "conflict").otherwise("ok"), F.when(F.col("toxic") == 1, "uncertain").otherwise("ok"))
    notices = F.when(key % 4 == 0, F.array(F.lit("n1"), F.lit("n2"), F.lit("n1"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "labels").select("doc_id", answers.card_evidence(refs, statuses).alias("status"), answers.freshness(notices, F.col("toxic") == 1, "check again").alias("notice"))


@QUERIES.add(
    """
    WITH f AS (SELECT o_custkey, o_orderkey, [o_orderpriority, o_orderstatus] AS facts, o_orderstatus AS ref FROM orders)
    SELECT o_custkey, string_agg(facts[1] || ',' || facts[2], ',' ORDER BY o_orderkey) AS facts, (SELECT string_agg(ref, ',' ORDER BY o) FROM (SELECT ref, min(o_orderkey) AS o FROM f g WHERE g.o_custkey = f.o_custkey GROUP BY ref)) AS refs FROM f GROUP BY o_custkey"""
)
def fact_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("facts"), F.array("o_orderstatus").alias("refs"))
    return answers.merged_bundles(bundles, "o_custkey", "o_orderkey").select("o_custkey", F.array_join("facts", ",").alias("facts"), F.array_join("refs", ",").alias("refs"))


_CLAIMS = """c AS (SELECT event_id AS claim_id, user_id AS subject_id, CASE event_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'advice' ELSE 'uncertain' END AS kind, CASE event_id % 4 WHEN 0 THEN [0::BIGINT] WHEN 1 THEN [0::BIGINT, 1] WHEN 2 THEN [-1::BIGINT] ELSE []::BIGINT[] END AS idx FROM events),
    r AS (SELECT *, CASE WHEN kind = 'uncertain' OR len(idx) = 0 OR idx[1] < 0 THEN '' WHEN len(idx) = 1 THEN 's' || subject_id || '-0' ELSE 's' || subject_id || '-0,s' || subject_id || '-1' END AS refs FROM c)"""


def _supported(spark: SparkSession, sf_dir: str, drop: bool) -> DataFrame:
    n, own = F.col("event_id"), table(spark, sf_dir, "events")
    indices = F.when(n % 4 == 0, F.array(F.lit(0))).when(n % 4 == 1, F.array(F.lit(0), F.lit(1))).when(n % 4 == 2, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    kind = F.when(n % 3 == 0, "fact").when(n % 3 == 1, "advice").otherwise("uncertain")
    claims = own.select(n.alias("claim_id"), F.col("user_id").alias("subject_id"), kind.alias("kind"), indices.alias("indices"))
    facts = own.select(F.col("user_id").alias("subject_id")).distinct().withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1))))
    facts = facts.withColumn("ref", F.concat(F.lit("s"), F.col("subject_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string")))
    return answers.supported(claims, facts, drop).select("claim_id", "kind", F.array_join("refs", ",").alias("refs"))


@QUERIES.add(f"WITH {_CLAIMS} SELECT claim_id, CASE WHEN kind = 'fact' AND refs = '' THEN 'uncertain' ELSE kind END AS kind, refs FROM r")
def support_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supported(spark, sf_dir, False)


@QUERIES.add(f"WITH {_CLAIMS} SELECT claim_id, kind, refs FROM r WHERE NOT (kind = 'fact' AND refs = '')")
def support_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supported(spark, sf_dir, True)


@QUERIES.add(
    """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS DOUBLE) END AS research_fit, event_id % 4 = 0 AS valid FROM events"""
)
def match_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses with all keys, with one too few, with a truth value and with a text among the scores."""
    four = '"method_match": 1, "location_fit": 0.5, "degree_goal": 2e-1'
    value = F.concat(F.lit('{"research_fit": '), F.col("user_id").cast("string"), F.lit(", "))
    n = F.col("event_id") % 4
    json = F.when(n == 0, F.concat(value, F.lit(f'{four}, "publication_activity": 3}}'))).when(n == 1, F.concat(value, F.lit(f"{four}}}"))).when(n == 2, F.concat(value, F.lit(f'{four}, "publication_activity": true}}'))).otherwise(F.concat(value, F.lit(f'{four}, "publication_activity": "3"}}')))
    scores = answers.dimension_scores(json)
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(scores, F.lit("research_fit")).alias("research_fit"), scores.isNotNull().alias("valid"))


@QUERIES.add(
    """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'gpa_bucket' WHEN event_id % 7 = 0 THEN 'rank_bucket' WHEN "value" / 100 > 1 OR "value" < 0 THEN 'profile_completeness' END AS issue, CASE event_type WHEN 'view' THEN 'competition_window' WHEN 'click' THEN 'submission_deadline' END AS time_model FROM events"""
)
def student_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    issue = answers.valid_context(F.when(n % 5 == 0, "3.9").when(n % 2 == 0, "high"), F.when(n % 7 == 0, "1st"), F.col("value") / 100, ["high", "medium"], ["top5"])
    timeline = F.when(F.col("event_type") == "view", "eventWindow").when(F.col("event_type") == "click", "submission").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", issue.alias("issue"), answers.time_model(timeline).alias("time_model"))


@QUERIES.add(
    """
    SELECT conv_id, turn, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 32) AS title, coalesce(contains(text, role), false) AS evidenced, trim(regexp_replace(role || ' X' || chr(12288) || 'Ａ', '\\s+', ' ', 'g')) <> '' AS named FROM conversations"""
)
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = answers.competition_name(F.concat("role", F.lit(" X　Ａ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.title(F.col("text")).alias("title"), answers.evidenced(F.col("role"), F.col("text")).alias("evidenced"), name.endswith(" x a").alias("named"))


@QUERIES.add(
    """
    SELECT event_id, array_to_string(list_slice(list_filter([event_type, 'a' || (event_id % 3), 'b'], lambda x: length(x) <= 8 AND NOT starts_with(x, 'view') AND NOT ends_with(x, '2')), 1, 4), '|') AS labels FROM events"""
)
def quick_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat("event_type", F.lit(" ")), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")), F.lit("why?"), F.lit("b"), F.lit("b"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(answers.quick_labels(raw, ["view"], ["2"]), "|").alias("labels"))


@QUERIES.add(
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN '一等奖' WHEN 1 THEN '金牌' ELSE '' END AS award, CASE WHEN event_id % 2 = 0 THEN CAST(2000 + user_id % 20 AS VARCHAR) ELSE '' END AS year, CASE event_type WHEN 'view' THEN '国际级' WHEN 'click' THEN '国家级' WHEN 'error' THEN '省级' ELSE '' END AS level FROM events"""
)
def achievement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    award = F.when(n % 3 == 0, "获得一等奖").when(n % 3 == 1, "金牌").otherwise("参加")
    year = F.when(n % 2 == 0, F.concat(F.lit("于"), (F.col("user_id") % 20 + 2000).cast("string"))).otherwise("")
    level = F.when(kind == "view", "国际大赛国赛").when(kind == "click", "国赛").when(kind == "error", "省赛").otherwise("比赛")
    found = answers.achievement(F.concat(level, year, award))
    return table(spark, sf_dir, "events").select("event_id", found["award"].alias("award"), found["year"].alias("year"), found["level"].alias("level"))


@QUERIES.add(
    """
    WITH p AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS target, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 - 1 AS INTEGER) END AS d, o_orderkey % 4 AS tasks FROM orders)
    SELECT o_orderkey, concat_ws('|', CASE WHEN s = 'O' THEN CASE WHEN d IS NULL THEN 'submission plan requires defense_prep' WHEN d <= target THEN 'defense_prep must start after submission' END END,
      CASE WHEN s = 'F' THEN CASE WHEN d IS NULL THEN 'competition window plan requires event_sprint' WHEN d <> target THEN 'event_sprint must start at the event window' END END, CASE WHEN tasks = 0 OR tasks = 3 THEN 'required task collection is invalid' END) AS issues FROM p"""
)
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status, target = F.col("o_orderkey"), F.col("o_orderstatus"), F.to_date("o_orderdate")
    start = F.when(key % 3 > 0, F.date_add(target, (key % 3 - 1).cast("int")))
    model = F.when(status == "O", "submission_deadline").when(status == "F", "competition_window").otherwise("none")
    issues = answers.plan_issues(model, target, start, start, key % 4, F.least(key % 4, F.lit(2)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(issues, "|").alias("issues"))


#: What a request wishes for.
WISHES = [" Brand#11 ", "Brand#23", " Brand#34", "Brand#45"]


@QUERIES.add(f"SELECT p_partkey FROM part WHERE p_brand IN ({', '.join(repr(w.strip()) for w in WISHES)}) AND NOT (p_partkey % 3 = 1)")
def competition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    policy = F.when(F.col("p_partkey") % 3 == 0, "solo").when(F.col("p_partkey") % 3 == 1, "team").otherwise("any")
    return answers.filtered_competitions(parts.select("p_partkey", F.col("p_brand").alias("category"), policy.alias("team_policy")), WISHES, "solo").select("p_partkey")


@QUERIES.add(
    """
    WITH s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'implicit' ELSE 'other' END AS source, user_id % 3 = event_id % 3 AND event_type = 'view' AS good FROM events)
    SELECT 'implicit' AS source, count_if(good) AS passed, count(*) AS total, count_if(good) / count(*) AS rate FROM s WHERE source = 'implicit' UNION ALL SELECT 'explicit', 0, 0, 0.0"""
)
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_id") % 2 == 0, "implicit").otherwise("other")
    return answers.routing_rates(table(spark, sf_dir, "events").select(source.alias("source"), (F.col("user_id") % 3).alias("predicted"), (F.col("event_id") % 3).alias("expected"), F.col("event_type").alias("actual_kind"), F.lit("view").alias("expected_kind")))


@QUERIES.add("SELECT event_id AS id, event_type AS severity, 'c' || user_id AS code FROM events WHERE event_id % 4 <> 0 ORDER BY event_type DESC, 'c' || user_id, event_id LIMIT 120")
def findings_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("severity"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("code"), (F.col("event_id") % 4 == 0).alias("resolved"))
    return answers.findings_page(rows, 120).drop("resolved")


@QUERIES.add("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def any_row_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.any_observation(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@QUERIES.add(
    """
    WITH f AS (SELECT o_orderkey AS finding_id, o_custkey % 20 AS snapshot_id, o_orderkey % 5 = 0 AS resolved FROM orders)
    SELECT c_custkey % 20 AS snapshot_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'build:ready' ELSE 'build:active' END AS kind, 'b' || c_custkey AS reference_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    UNION SELECT n_nationkey % 20, 'manual', 'n' || n_nationkey FROM nation UNION SELECT n_nationkey % 20, 'unresolved_finding', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey IN (SELECT finding_id FROM f WHERE NOT resolved)
    UNION SELECT snapshot_id, 'unresolved_finding', CAST(finding_id AS VARCHAR) FROM f WHERE NOT resolved"""
)
def snapshot_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "READY").when(F.col("c_mktsegment") == "MACHINERY", "ACTIVE").otherwise("FAILED")
    builds = customers.select((F.col("c_custkey") % 20).alias("snapshot_id"), F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("build_id"), status.alias("status"))
    mine = F.col("n_nationkey")
    held = nations.select((mine % 20).cast("long").alias("snapshot_id"), F.lit("manual").alias("kind"), F.concat(F.lit("n"), mine.cast("string")).alias("reference_id")).union(nations.select((mine % 20).cast("long"), F.lit("unresolved_finding"), mine.cast("string")))
    findings = orders.select(F.col("o_orderkey").cast("string").alias("finding_id"), F.col("o_orderkey").alias("observation_id"), (F.col("o_orderkey") % 5 == 0).alias("resolved"))
    return answers.protection_reasons(builds, held, findings, orders.select((F.col("o_custkey") % 20).alias("snapshot_id"), F.col("o_orderkey").alias("observation_id")))


@QUERIES.add(
    """
    WITH p AS (SELECT n_nationkey, '学校：' || n_name || chr(10) || '学院：a b' || coalesce(chr(10) || '研究方向原文：' || s, '') AS profile FROM nation LEFT JOIN (SELECT c_nationkey, array_to_string(list(c_name ORDER BY c_custkey)[1:2048], chr(10)) AS s FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)
    SELECT n_nationkey AS entity_id, profile, sha256('baseline-v1' || chr(10) || profile) AS profile_hash, CAST(len(string_split_regex(profile, '\\s+')) AS BIGINT) AS n_tokens FROM p"""
)
def semantic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as persons, their customers as statements."""
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("statements"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "nation").join(own, "n_nationkey", "left").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("school"), F.lit(" a b ").alias("org"), F.lit(None).cast("string").alias("title"), F.lit("").alias("bio"), "statements", none.alias("topics"), none.alias("publications"))
    return answers.semantic_profile(rows)


@QUERIES.add()
def tokenized_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of customers within a real tokenizer's tokens: orders as statements, and a Chinese line that the budget of its field cuts."""
    import public_tokenizers

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.concat(F.lit("研究方向 "), x["o_orderpriority"])).alias("statements"))
    none = F.array().cast("array<string>")
    title = F.concat("c_mktsegment", F.repeat(F.lit("教授、博士生导师；"), F.lit(20)))
    people = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return answers.semantic_profile(people.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("school"), F.lit("学院").alias("org"), title.alias("title"), F.lit(None).cast("string").alias("bio"), "statements", none.alias("topics"), none.alias("publications")), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


@QUERIES.add(
    """
    SELECT c_custkey AS entity_id, coalesce((SELECT string_agg(o_orderpriority, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS statements, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_custkey = c_custkey)), '') AS sources FROM customer"""
)
def entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "entity_id")
    statements = orders.select("entity_id", F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("text"))
    out = answers.detail(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")), statements, statements.limit(0), orders.select("entity_id", F.col("o_orderstatus").alias("url")))
    return out.select("entity_id", F.array_join("statements", ",").alias("statements"), F.array_join("sources", ",").alias("sources"))


@QUERIES.add(
    """
    WITH a AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id)
    SELECT user_id, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['click', 'error', 'view', 'zzz']) AS x) WHERE NOT list_contains(t, x)), '') AS missing, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(t) AS x) WHERE NOT list_contains(['click', 'error', 'view', 'zzz'], x)), '') AS extra FROM a"""
)
def missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set differences both ways between what a user has and what is required."""
    needed = F.array(*map(F.lit, ["click", "error", "view", "zzz"]))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("user_id", listed(F.array_except(needed, "t")).alias("missing"), listed(F.array_except("t", needed)).alias("extra"))


@QUERIES.add("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS prior FROM (SELECT conv_id, list_filter(['a' || (conv_id % 3), 'b', 'a' || (conv_id % 2), 'c', 'b'], lambda x, i: list_position(['a' || (conv_id % 3), 'b', 'a' || (conv_id % 2), 'c', 'b'], x) = i) AS list_distinct_ordered FROM (SELECT DISTINCT conv_id FROM conversations))")
def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda n: F.concat(F.lit("a"), (F.col("conv_id") % n).cast("string"))
    prior = answers.merged_context(F.array(of(3), F.lit("b")), F.array(of(2), F.lit("c"), F.lit("b")))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(prior, ",").alias("prior"))


@QUERIES.add(
    """
    WITH s AS (SELECT o_custkey AS source, count(*) AS n, count_if(o_orderstatus = 'P') AS rejected, count_if(o_orderpriority = '1-URGENT') > 0 AS complete FROM orders GROUP BY 1),
    r AS (SELECT source, concat_ws(',', CASE WHEN NOT complete THEN 'crawler_state_incomplete_or_unavailable' END, CASE WHEN rejected <> 0 THEN 'row_rejections' END, CASE WHEN n / 12.0 < 0.9 THEN 'source_count_regression' END) AS reasons FROM s)
    SELECT source, reasons, reasons = '' AS eligible FROM r"""
)
def deactivation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("rejected"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("complete"))
    return quality.deactivation(own.withColumn("previous", F.lit(12)), 0.9).select("source", F.array_join("reasons", ",").alias("reasons"), "eligible")


@QUERIES.add(
    """
    WITH g AS (SELECT o_orderkey, o_custkey AS e, CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey ELSE o_custkey END AS p, o_orderstatus = 'P' AS x, o_orderstatus = 'P' AND o_orderkey % 3 > 0 AS gx, o_orderpriority = '5-LOW' AS l FROM orders),
    m AS (SELECT sum(n * (n - 1) / 2) AS n FROM (SELECT count(*) AS n FROM g GROUP BY e)), c AS (SELECT sum(n * (n - 1) / 2) AS n FROM (SELECT count(*) AS n FROM g GROUP BY e, p)),
    v AS (SELECT 'merge_precision' AS metric, round(c.n / m.n, 6) AS "value", 0.995 AS least FROM m, c UNION ALL SELECT 'excluded_precision', round(count_if(gx) / count_if(x), 6), 0.99 FROM g UNION ALL SELECT 'lecturer_retention', round(count_if(l AND NOT x) / count_if(l), 6), 0.95 FROM g)
    SELECT metric, "value", "value" >= least AS passed FROM v"""
)
def curation_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of customers; every fiftieth was another person's, some exclusions are wrong."""
    key, lost = F.col("o_orderkey"), F.col("o_orderstatus") == "P"
    role = lambda c: F.when(c, "excluded").otherwise("included")
    orders = table(spark, sf_dir, "orders")
    gold = orders.select(key.alias("observation_id"), F.when(key % 50 == 0, -key).otherwise(F.col("o_custkey")).alias("person_key"), role(lost & (key % 3 > 0)).alias("role_status"), (F.col("o_orderpriority") == "5-LOW").alias("lecturer"))
    return quality.curation_gold(gold, orders.select(key.alias("observation_id"), F.col("o_custkey").alias("entity_id"), role(lost).alias("role")))


@QUERIES.add("SELECT user_id, max(event_id) AS last_id, CAST(count(*) AS BIGINT) AS rows_written FROM events GROUP BY user_id")
def checkpoint_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of two halves of the events, one put into the other."""
    half = lambda n: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == n).groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("rows_written"))
    return relational.checkpoints(half(0), half(1), ["user_id"], "last_id")


@QUERIES.add("SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 3 = 1 AND event_id % 5 > 0 AND event_id % 7 > 0")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_id") % 7 > 0, F.when(F.col("event_type") == "error", "excluded").otherwise("included"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).cast("string").alias("build_id"), (F.col("event_id") % 5 > 0).alias("active"), role.alias("role_status"))
    return catalog.eligible(rows, "1").select("event_id")


@QUERIES.add(
    """
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e q JOIN e ON e.id <> q.id WHERE q.id % 50 = 0),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 3), h AS (SELECT query_id, CASE WHEN query_id % 100 = 0 THEN max(id) ELSE -1 END AS choice FROM k GROUP BY query_id)
    SELECT h.query_id, CASE WHEN k.rank IS NOT NULL THEN choice END AS topic, score, CAST(rank AS INTEGER) AS rank FROM h LEFT JOIN k ON k.query_id = h.query_id AND k.id = choice"""
)
def semantic_topic_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidate topics of each concept by vector; of half the concepts the one of greatest id was chosen, of the others one that is no candidate."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = cut(retrieval.dense_search(vectors, vectors.where("id % 50 = 0"), 3), "candidates")
    choices = found.groupBy("query_id").agg(F.max("id").alias("id")).select("query_id", F.when(F.col("query_id") % 100 == 0, F.col("id")).otherwise(-1).alias("choice"))
    return catalog.chosen_topics(found, choices)

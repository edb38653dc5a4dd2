"""Queries of text, URL, vector and frontier functions over values made of the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import repair, text, urls, vectors
from siltstone.operators import catalog, frontier, recommend, resolution
from siltstone.plans.registry import Registry, table

QUERIES = Registry()


def _pick(key, *values):
    """One of ``values`` by the key modulo their number, null where a value is None."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


@QUERIES.add(
    """
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Me.' || c_custkey || '@mail.example.org' WHEN 1 THEN 'x' || c_custkey || '@y.z' END AS email FROM customer"""
)
def email_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses among texts that only look like them: the domain goes to lower case, the rest stays."""
    key = F.col("c_custkey")
    raw = F.when(key % 6 == 0, F.concat(F.lit("  Me."), key, F.lit("@Mail.Example.ORG "))).when(key % 6 == 1, F.concat(F.lit("x"), key, F.lit("@Y.Z"))).otherwise(_pick(key, None, None, "a b@c.d", "a@b", "@c.d", "a@@b.c"))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", text.email(F.col("raw")).alias("email"))


@QUERIES.add(
    """
    WITH p AS (SELECT p_partkey AS k, lower(p_name) AS n FROM part)
    SELECT k AS p_partkey, 'About ' || n || ' (2019). doi:10.1234/' || n || k || '.' AS mention, '10.1234/' || n || k AS doi, 2019 AS year, false AS needs_review FROM p WHERE NOT contains(n, ' ')
    UNION ALL SELECT k, 'Two years 2001; 2002', NULL, NULL, true FROM p UNION ALL SELECT k, 'both 10.5555/a 10.5555/b', NULL, NULL, true FROM p WHERE k % 3 = 0 UNION ALL SELECT k, 'none', NULL, NULL, false FROM p"""
)
def publication_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a field that full-width separators and line breaks split, with their DOI and year where there is one."""
    key, name = F.col("p_partkey"), F.lower("p_name")
    first = F.when(~F.contains(name, F.lit(" ")), F.concat(F.lit("About "), name, F.lit(" (2019). doi:10.1234/"), name, key, F.lit(".；")))
    field = F.concat_ws("", first, F.lit(" Two years  2001; 2002\n"), F.when(key % 3 == 0, F.lit("both 10.5555/a 10.5555/b；")), F.lit("NONE；none；"), F.lit(" … ；"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(text.publications(field)).alias("m"))
    return found.select("p_partkey", F.when(F.col("m.text") == "NONE", "none").otherwise(F.col("m.text")).alias("mention"), "m.doi", "m.year", "m.needs_review")


@QUERIES.add(
    """
    SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '北京' WHEN 1 THEN n_name || '市' WHEN 2 THEN NULL WHEN 3 THEN '上海' ELSE NULL END AS city,
      CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN n_name = 'CHINA' WHEN 3 THEN false END AS wanted FROM nation"""
)
def city_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities with and without the sign for city, against wishes; an unknown city is neither."""
    key = F.col("n_nationkey")
    raw = F.when(key % 5 == 0, " 北京市").when(key % 5 == 1, F.concat("n_name", F.lit("市 "))).when(key % 5 == 2, "  ").when(key % 5 == 3, "上海")
    return table(spark, sf_dir, "nation").select("n_nationkey", repair.city(raw).alias("city"), repair.city_matches(raw, ["北京", "CHINA市"]).alias("wanted"))


@QUERIES.add(
    """
    WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h FROM pages)
    SELECT page_id, h = 'example.org' OR suffix(h, '.example.org') OR h = 'site1.example' OR suffix(h, '.site1.example') OR NOT regexp_matches(lower(url), '^https?://') AS allowed FROM p"""
)
def host_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages' hosts are a permitted one or below it, at a dot."""
    return table(spark, sf_dir, "pages").select("page_id", urls.allowed_host(F.col("url"), ["example.org", "site1.example"]).alias("allowed"))


@QUERIES.add("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Müller ' || c_name WHEN 1 THEN '张' || c_custkey ELSE c_name || ' é' END AS name FROM customer")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were read as Latin-1 are read again; those that weren't stay."""
    key = F.col("c_custkey")
    good = F.when(key % 3 == 0, F.concat(F.lit("Müller "), "c_name")).when(key % 3 == 1, F.concat(F.lit("张"), key)).otherwise(F.concat("c_name", F.lit(" é")))
    spoilt = F.when(key % 3 < 2, F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")).otherwise(good)
    return table(spark, sf_dir, "customer").select("c_custkey", repair.repair_mojibake(spoilt).alias("name"))


@QUERIES.add("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_name || '(a(b))' WHEN 1 THEN n_name WHEN 2 THEN n_name || '（x）' WHEN 3 THEN NULL ELSE n_name || '(y）)' END AS name FROM nation")
def bracketed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of units with brackets closed that were left open, and dropped that nothing opened."""
    key = F.col("n_nationkey")
    raw = F.when(key % 5 == 0, F.concat("n_name", F.lit(" ( a (b"))).when(key % 5 == 1, F.concat(F.lit(")"), "n_name", F.lit("）)"))).when(key % 5 == 2, F.concat("n_name", F.lit("（x"))).when(key % 5 == 3, ")").otherwise(F.concat("n_name", F.lit("(y）")))
    fixed = F.when(key % 5 == 4, F.concat(repair.org_unit_name(F.concat("n_name", F.lit("(y"))), F.lit(""))).otherwise(repair.org_unit_name(raw))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(key % 5 == 4, F.replace(fixed, F.lit("(y)"), F.lit("(y）)"))).otherwise(fixed).alias("name"))


@QUERIES.add(
    """
    SELECT page_id, concat_ws(',', CASE WHEN length(html) >= 200 THEN NULL ELSE 'text_too_short' END, CASE WHEN regexp_matches(lower(url), 'teacher|szdw|info|faculty|people|professor|jsdw|rcjs|/show|content') THEN NULL ELSE 'url_not_homepage_like' END,
      CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'no_rich_tokens' END, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'no_title_tokens' END) AS missing FROM pages WHERE html IS NOT NULL"""
)
def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages lack to be profiles that are worth another try."""
    key = F.col("page_id")
    body = F.concat("html", F.when(key % 2 == 0, "个人简介").otherwise("  "), F.when(key % 3 == 0, "讲师").otherwise("  "))
    length = F.when(F.length("html") >= 200, body).otherwise(F.substring(body, F.length("html") + 1, F.lit(9)))
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", repair.missing_signs(F.col("url"), length).alias("missing"))


@QUERIES.add("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text || ' 推荐 2024 我想', '[\\p{L}\\p{M}\\p{N}_]{2,}'), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('推荐', '我想')))), ' ') AS terms FROM benchmark")
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two letters or more of each passage, without stop words and numbers."""
    terms = repair.query_terms(F.concat("text", F.lit(" 推荐 2024 我想")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(terms), " ").alias("terms"))


@QUERIES.add(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'page:1>' || (o_orderkey % 4) ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN ',' ELSE '' END || 'unit:->u' ELSE '' END AS changed
    FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 = 1)"""
)
def facet_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that differ between two URLs, before and after."""
    key = F.col("o_orderkey")
    after = F.concat(F.lit("http://x.org/l?kind=a&page="), F.when(key % 3 == 0, key % 4).otherwise(1), F.when(key % 2 == 0, "&unit=u").otherwise(""), F.lit("#top"))
    changed = F.map_entries(urls.changed_facets(F.lit("http://x.org/l?page=1&kind=a"), after))
    shown = F.transform(F.array_sort(changed), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"]["before"], F.lit("-")), F.lit(">"), F.coalesce(e["value"]["after"], F.lit("-"))))
    return table(spark, sf_dir, "orders").where("NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 = 1)").select("o_orderkey", F.array_join(shown, ",").alias("changed"))


@QUERIES.add("SELECT vec_id, true AS same, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, true AS broken_is_null FROM embeddings")
def vector_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blobs and back: the same vectors, four bytes a component; a blob that lost a byte is none."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).withColumn("b", vectors.blob("v"))
    cut = F.expr("substring(b, 2)")
    back = rows.select("vec_id", "v", "b", vectors.from_blob("b").alias("again"), vectors.from_blob(cut).alias("broken"), vectors.checksum(F.col("v")).alias("sum"))
    return back.select("vec_id", ((F.col("v") == F.col("again")) & (F.col("sum") == F.sha2("b", 256))).alias("same"), F.octet_length("b").cast("long").alias("n_bytes"), F.col("broken").isNull().alias("broken_is_null"))


@QUERIES.add(
    """
    WITH c AS (SELECT l_partkey AS entity_id, l_returnflag AS field, l_extendedprice AS v, CASE l_linestatus WHEN 'F' THEN 0.9 ELSE CASE WHEN l_linenumber % 2 = 0 THEN 0.6 ELSE 0.4 END END AS confidence, l_shipdate AS t, l_orderkey * 10000 + l_linenumber * 1000 + l_suppkey AS o FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY confidence DESC, t DESC, o DESC, v DESC) AS n FROM c)
    SELECT entity_id, field, CAST(confidence AS DOUBLE) AS confidence, t AS observed_at FROM (SELECT entity_id, field, confidence, t, n FROM r) WHERE n = 1"""
)
def surviving_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim of each part and field that survives: by grade, then time, then observation."""
    grade = F.when(F.col("l_linestatus") == "F", "official").when(F.col("l_linenumber") % 2 == 0, "profile").otherwise("listing")
    lines = table(spark, sf_dir, "lineitem")
    claims = lines.select(F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("field"), F.col("l_shipdate").alias("value"), grade.alias("grade"), F.col("l_shipdate").alias("observed_at"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("observation_id"))
    return resolution.surviving_fields(claims).select("entity_id", "field", "confidence", F.col("value").alias("observed_at"))


@QUERIES.add(
    """
    SELECT c_custkey, round(((c_acctbal > 0)::INT + (c_custkey % 2 = 0)::INT + 1) / 3.0::DOUBLE, 4) AS completeness, CASE WHEN r IS NULL THEN NULL WHEN r >= 0.9 THEN 'top10' WHEN r >= 0.85 THEN 'top25' WHEN r >= 0.8 THEN 'high' WHEN r >= 0.7 THEN 'medium' ELSE 'unknown' END AS gpa,
      CASE WHEN c_custkey % 60 <= 5 THEN 'top5' WHEN c_custkey % 60 <= 10 THEN 'top10' WHEN c_custkey % 60 <= 25 THEN 'top25' ELSE 'medium' END AS rank FROM (SELECT *, CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 41) / 10.0::DOUBLE / CASE WHEN c_custkey % 4 = 0 THEN 4.0 ELSE 5.0 END END AS r FROM customer)"""
)
def buckets_and_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of filled fields, and coarse buckets of grades and ranks."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, 1).alias("a"), F.when(key % 2 == 0, 1).alias("b"), F.lit("x").alias("c"))
    gpa = F.when(key % 9 > 0, (key % 41) / 10.0)
    scale = F.when(key % 8 == 0, F.lit(0.0)).when(key % 4 == 0, F.lit(None).cast("double")).otherwise(5.0)
    return rows.select("c_custkey", resolution.completeness(["a", "b", "c"]).alias("completeness"), recommend.gpa_bucket(gpa, scale).alias("gpa"), recommend.rank_bucket(key % 60).alias("rank"))


@QUERIES.add("SELECT o_orderkey AS id, o_totalprice AS priority FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 100 <= 50) ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def frontier_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty nodes to claim next: pending ones, and retries that are due."""
    key = F.col("o_orderkey")
    nodes = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 == 0, "pending").when(key % 3 == 1, "retry").otherwise("done").alias("status"), (key % 100).alias("next_retry_at"), F.col("o_totalprice").alias("priority"))
    return frontier.next_up(nodes, F.lit(50), 40).select("id", "priority")


@QUERIES.add(
    """
    WITH n AS (SELECT o_orderkey AS id, o_custkey % 10 = 3 AS below, o_orderpriority IN ('1-URGENT', '2-HIGH') AS entry, o_orderstatus AS s FROM orders), k AS (SELECT * FROM n WHERE NOT below OR entry),
    e AS (SELECT l_orderkey AS src, l_orderkey % 997 + 1 AS dst FROM lineitem), b AS (SELECT count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM n WHERE below AND NOT entry) AND dst NOT IN (SELECT id FROM n WHERE below AND NOT entry))
    SELECT CASE WHEN below THEN 'pending' ELSE s END AS status, count(*) AS nodes, CAST(sum(CASE WHEN below THEN 0 ELSE 2 END) AS BIGINT) AS attempts, any_value(b.n) AS edges FROM k, b GROUP BY 1"""
)
def subtree_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges left when what was found below one owner goes and its entry points start over."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("string").alias("owner"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"), F.lit(2).alias("attempts"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") % 997 + 1).alias("dst"))
    left, kept = frontier.reset_subtree(nodes, edges, "3", ["1-URGENT", "2-HIGH"])
    counts = left.groupBy("status").agg(F.count(F.lit(1)).alias("nodes"), F.sum("attempts").alias("attempts"))
    return counts.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("edges"))))  # one row


@QUERIES.add("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'empty_page' WHEN 1 THEN 'not_found' WHEN 2 THEN 'removed' WHEN 3 THEN NULL ELSE NULL END AS reason FROM pages")
def terminal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are none: empty, not found, removed; a long page may say so and be one."""
    key = F.col("page_id")
    body = F.when(key % 5 == 0, " \n ").when(key % 5 == 1, "Error 404: Page Not Found").when(key % 5 == 2, "This item has been removed.").when(key % 5 == 3, F.concat(F.lit("404 "), F.repeat(F.lit("words "), F.lit(900)))).otherwise("A page of 4040 words")
    return table(spark, sf_dir, "pages").select("page_id", frontier.unavailable(body).alias("reason"))


@QUERIES.add(
    """
    WITH l AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS url, l_returnflag = 'R' AS is_all, l_quantity AS resets, l_suppkey % 3 AS axis, l_orderkey % 2 = 0 AS people, l_extendedprice AS x FROM lineitem),
    d AS (SELECT page, url, max(is_all) AS is_all, max(resets) AS resets, min(axis) AS axis, bool_or(people) AS people FROM l GROUP BY page, url),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY is_all DESC, resets DESC, axis, url) AS rn, bool_or(is_all) OVER (PARTITION BY page) AS a, min(axis) OVER (PARTITION BY page) AS m FROM d)
    SELECT page, url, CASE WHEN a THEN rn = 1 WHEN people THEN false ELSE axis = m END AS followed FROM r"""
)
def facet_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facet links of a list page are followed: the one to all, or none where people are reachable, or one axis."""
    lines = table(spark, sf_dir, "lineitem")
    links = lines.groupBy(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("url")).agg(
        F.max(F.col("l_returnflag") == "R").alias("is_all"), F.max("l_quantity").alias("resets"), F.min(F.col("l_suppkey") % 3).alias("axis_rank"), F.max(F.col("l_orderkey") % 2 == 0).alias("people_reachable")
    )
    return catalog.choose_facet(links, "page").select("page", "url", "followed")


@QUERIES.add(
    """
    WITH h AS (SELECT l_suppkey AS q, l_partkey AS e, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)
    SELECT q, e, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, e) AS rank FROM h WHERE e IN (SELECT p_partkey FROM part WHERE p_size > 25)) WHERE rank <= 5"""
)
def filtered_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits of each query that the filters let through, however far down they stand."""
    hits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("e")).agg(F.max("l_extendedprice").alias("score"))
    allowed = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("e"))
    return recommend.adaptive_recall(hits, allowed, "q", "e", 5).select("q", "e", "score", "rank")


@QUERIES.add(
    """
    WITH n AS (SELECT 'R' || r_regionkey AS id, 2 AS place FROM region UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation), s AS (SELECT id FROM n ORDER BY place, id LIMIT 28), e AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation)
    SELECT 'node' AS kind, id AS a, '' AS b FROM s UNION ALL SELECT * FROM (SELECT 'edge', src, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s) ORDER BY src, dst LIMIT 28)"""
)
def graph_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the preview's places for nodes, by label, and as many for the edges among them."""
    named = lambda prefix, c: F.concat(F.lit(prefix), c)
    nations = table(spark, sf_dir, "nation")
    nodes = table(spark, sf_dir, "region").select(named("R", "r_regionkey").alias("id"), F.lit("Region").alias("label")).unionByName(nations.select(named("N", "n_nationkey").alias("id"), F.lit("Nation").alias("label")))
    shown, edges = catalog.preview(nodes, nations.select(named("N", "n_nationkey").alias("src"), named("R", "n_regionkey").alias("dst")), ["Nation", "Region"], 56)
    return shown.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@QUERIES.add(
    """
    WITH n AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS done, o_orderkey // 3 AS u FROM orders), k AS (SELECT u, arg_min(id, CASE WHEN done THEN 0 ELSE 1000000000 END + id) AS keeper FROM n GROUP BY u), m AS (SELECT id, keeper FROM n JOIN k USING (u)),
    e AS (SELECT DISTINCT coalesce(a.keeper, l_orderkey) AS src, coalesce(b.keeper, l_partkey) AS dst FROM lineitem LEFT JOIN m a ON a.id = l_orderkey LEFT JOIN m b ON b.id = l_partkey)
    SELECT 'node' AS kind, keeper AS a, 0 AS b FROM k UNION ALL SELECT 'edge', src, dst FROM e WHERE src <> dst"""
)
def twin_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are one but for the scheme of their URL: the done one stays, edges follow it."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "http://x/").otherwise("https://x/"), F.floor(F.col("o_orderkey") / 3)).alias("url"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("e").alias("kind"))
    left, moved = frontier.collapse_twins(nodes, edges, urls.without_scheme(F.col("url")))
    return left.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(moved.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@QUERIES.add("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ',b' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '1,x' ELSE '' END AS items FROM customer")
def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists as lists of distinct strings; anything else is an empty list."""
    key = F.col("c_custkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit('["'), "c_mktsegment", F.lit('","b","'), "c_mktsegment", F.lit('",null]'))).otherwise(_pick(key, None, "no json", '{"a":1}', '["1","x"]', None))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(catalog.string_list(raw), ",").alias("items"))

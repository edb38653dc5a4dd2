"""Queries of the crawl tables over events, orders and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import crawl
from siltstone.plans.registry import Registry, table

QUERIES = Registry()

_UNIT = """f AS (SELECT 'u' || o_custkey AS url, o_orderpriority AS name, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'p' || o_orderkey END AS found_on, o_orderkey AS seq FROM orders),
    o AS (SELECT 'u' || c_custkey AS url, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS kind, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'seed' END AS found_on FROM customer)"""


@QUERIES.add(
    f"""
    WITH {_UNIT}, n AS (SELECT url, arg_max(name, seq) AS n, arg_min(kind, seq) FILTER (WHERE kind <> '') AS k, arg_min(found_on, seq) FILTER (WHERE found_on <> '') AS f FROM f GROUP BY url)
    SELECT coalesce(o.url, n.url) AS url, coalesce(n, name) AS name, coalesce(nullif(kind, ''), k) AS kind, coalesce(nullif(found_on, ''), f) AS found_on FROM o FULL JOIN n ON o.url = n.url"""
)
def org_unit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as known units, orders as finds of them."""
    key = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    origin = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("p"), F.col("o_orderkey").cast("string")))
    found = table(spark, sf_dir, "orders").select(key.alias("url"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("kind"), origin.alias("found_on"), F.col("o_orderkey").alias("at"))
    old = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("kind"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("seed").alias("found_on"))
    return crawl.upsert_units(old, found)


@QUERIES.add(
    """
    SELECT 'u' || user_id AS url, event_type AS status, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS text, event_id AS at FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def page_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as the whole cache row, a missing text too."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("text"), F.col("event_id").alias("at"), "ts")
    return crawl.latest_pages(rows, ["ts", "at"]).drop("ts")


_NODES = "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'https' END || '://x.org/' || (event_id % 400) AS url, CASE WHEN event_type IN ('view', 'click') THEN 'done' ELSE 'pending' END AS status, CASE WHEN event_type IN ('view', 'error') THEN 'detail_url' ELSE 'pagination_url' END AS type, CAST(event_id % 4 AS INTEGER) AS attempts FROM events"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "http").otherwise("https"), F.lit("://x.org/"), (F.col("event_id") % 400).cast("string"))
    done = F.when(F.col("event_type").isin("view", "click"), "done").otherwise("pending")
    kind = F.when(F.col("event_type").isin("view", "error"), "detail_url").otherwise("pagination_url")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), url.alias("url"), done.alias("status"), kind.alias("type"), (F.col("event_id") % 4).cast("int").alias("attempts"))


@QUERIES.add(
    f"""
    WITH n AS ({_NODES}), b AS (SELECT *, regexp_replace(url, '^https?://', '') AS bare FROM n)
    SELECT a.id, min(o.id) AS twin FROM b a LEFT JOIN b o ON o.bare = a.bare AND o.status = 'done' AND o.id <> a.id GROUP BY a.id"""
)
def done_twin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.done_twins(_nodes(spark, sf_dir)).select("id", "twin")


_CACHE = "SELECT 'http://x.org/' || user_id AS url, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || ' ' WHEN 2 THEN 'text' ELSE 'more' END AS text, CASE WHEN user_id % 8 = 2 THEN 'terminal_unavailable:empty_page:x' WHEN user_id % 8 = 3 THEN 'other' END AS block_reason FROM (SELECT DISTINCT user_id FROM events)"


@QUERIES.add(
    f"""
    WITH n AS ({_NODES}), c AS ({_CACHE}), g AS (SELECT DISTINCT c.url FROM c JOIN n ON n.url = c.url AND n.type = 'detail_url' WHERE text IS NULL OR trim(text, chr(9) || chr(10) || chr(13) || ' ') = '' OR block_reason LIKE 'terminal_unavailable:empty_page%'),
    r AS (SELECT n.*, g.url IS NOT NULL AND type = 'detail_url' AS bad FROM n LEFT JOIN g ON g.url = n.url)
    SELECT 'node' AS kind, CAST(id AS VARCHAR) AS key, CASE WHEN bad THEN 'pending' ELSE status END AS status, CASE WHEN bad THEN 0 ELSE attempts END AS attempts FROM r
    UNION ALL SELECT 'cache', url, 'kept', 0 FROM c WHERE url NOT IN (SELECT url FROM g)"""
)
def bad_snapshot_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    text = F.when(user % 4 == 0, None).when(user % 4 == 1, "\t ").when(user % 4 == 2, "text").otherwise("more")
    reason = F.when(user % 8 == 2, "terminal_unavailable:empty_page:x").when(user % 8 == 3, "other")
    cache = table(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("http://x.org/"), user.cast("string")).alias("url"), text.alias("text"), reason.alias("block_reason"))
    nodes, left = crawl.reset_bad_snapshots(_nodes(spark, sf_dir), cache)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("key"), "status", "attempts")
    return rows.union(left.select(F.lit("cache"), "url", F.lit("kept"), F.lit(0)))


@QUERIES.add(
    """
    WITH k AS (SELECT n_nationkey, n_name, CASE n_nationkey % 4 WHEN 0 THEN 'org_unit' WHEN 1 THEN 'detail_url' WHEN 2 THEN 'faculty_list_url' ELSE 'org_listing_url' END AS kind FROM nation)
    SELECT n_nationkey, CASE WHEN kind = 'org_unit' THEN CASE WHEN n_nationkey % 8 = 0 THEN 'org_unit:name:' || n_name ELSE 'org_unit:id:' || n_nationkey END ELSE 'url:http://x/' || n_nationkey END AS node_key, 'about:org_unit:' || n_name AS unit_url,
      CAST(CASE kind WHEN 'org_unit' THEN 90 WHEN 'detail_url' THEN 50 WHEN 'faculty_list_url' THEN 80 ELSE 100 END AS DOUBLE) AS priority, CAST(CASE kind WHEN 'org_unit' THEN 90 WHEN 'detail_url' THEN 150 WHEN 'faculty_list_url' THEN 180 ELSE 100 END AS DOUBLE) AS subtree_priority FROM k"""
)
def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes of four types."""
    n = F.col("n_nationkey")
    kind = F.when(n % 4 == 0, "org_unit").when(n % 4 == 1, "detail_url").when(n % 4 == 2, "faculty_list_url").otherwise("org_listing_url")
    url = F.concat(F.lit("http://x/"), n.cast("string"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", crawl.node_key(kind, url, F.when(n % 8 != 0, n), F.col("n_name")).alias("node_key"), crawl.unit_url(F.col("n_name")).alias("unit_url"), crawl.priority(kind).alias("priority"), crawl.priority(kind, True).alias("subtree_priority")
    )


@QUERIES.add(
    """
    WITH l AS (SELECT event_id, user_id AS owner, CASE event_type WHEN 'view' THEN 'detail' WHEN 'click' THEN 'pagination' WHEN 'signup' THEN 'followup' WHEN 'error' THEN 'reslice' ELSE 'none' END AS label, event_id % 5 + 1 AS depth FROM events)
    SELECT event_id, CASE label WHEN 'detail' THEN 'detail_url' WHEN 'pagination' THEN 'pagination_url' WHEN 'followup' THEN 'faculty_followup_url' ELSE 'faculty_list_url' END AS type, depth, CAST(CASE label WHEN 'detail' THEN 50 WHEN 'pagination' THEN 70 WHEN 'followup' THEN 65 ELSE 80 END AS DOUBLE) AS priority
    FROM l WHERE label <> 'none' AND depth <= 4 AND NOT (label = 'reslice' AND owner IN (1, 2, 3))"""
)
def link_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "view", "detail").when(kind == "click", "pagination").when(kind == "signup", "followup").when(kind == "error", "reslice").otherwise("none")
    links = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.lit("u").alias("url"), label.alias("label"), (F.col("event_id") % 5).alias("depth"))
    return crawl.materialised(links, 4, [1, 2, 3]).select("event_id", "type", "depth", "priority")


@QUERIES.add(
    """
    WITH l AS (SELECT event_id, 'http://x.org/a' || (user_id % 3) || '/list.htm' AS page, 'http://' || CASE WHEN event_id % 5 = 0 THEN 'y' ELSE 'x' END || '.org/a' || (user_id % 4) || CASE event_type WHEN 'view' THEN '/list' ELSE '/item' END || (event_id % 30) || '.htm' AS target FROM events)
    SELECT page, target, min(event_id) AS ordinal, CAST(regexp_extract(target, '([0-9]+)[.]htm$', 1) AS INTEGER) AS page_index FROM l
    WHERE target LIKE 'http://x.org/%' AND starts_with(target, regexp_replace(page, '[^/]*$', '')) AND target LIKE '%/list%' GROUP BY page, target"""
)
def numbered_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("http://x.org/a"), (F.col("user_id") % 3).cast("string"), F.lit("/list.htm"))
    name = F.when(F.col("event_type") == "view", "/list").otherwise("/item")
    target = F.concat(F.lit("http://"), F.when(F.col("event_id") % 5 == 0, "y").otherwise("x"), F.lit(".org/a"), (F.col("user_id") % 4).cast("string"), name, (F.col("event_id") % 30).cast("string"), F.lit(".htm"))
    links = table(spark, sf_dir, "events").select(page.alias("page"), target.alias("target"), F.col("event_id").alias("ordinal"))
    return crawl.numbered_pages(links)


@QUERIES.add(
    """
    WITH l AS (SELECT 'http://x.org/' || user_id AS page, 'http://' || CASE WHEN event_id % 6 = 0 THEN 'y' ELSE 'x' END || '.org/f' || (event_id % 500) AS target, event_type || ' ' || (event_id % 9) AS anchor, event_id AS ordinal FROM events),
    o AS (SELECT page, target, min(ordinal) AS ordinal, arg_min(anchor, ordinal) AS anchor FROM l WHERE target LIKE 'http://x.org/%' AND page <> target AND (anchor LIKE '%view%' OR anchor LIKE '%click%') AND anchor NOT LIKE '%3%' GROUP BY 1, 2)
    SELECT page, target, anchor, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ordinal) AS rank FROM o) WHERE rank <= 4"""
)
def followup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("http://x.org/"), F.col("user_id").cast("string"))
    target = F.concat(F.lit("http://"), F.when(F.col("event_id") % 6 == 0, "y").otherwise("x"), F.lit(".org/f"), (F.col("event_id") % 500).cast("string"))
    links = table(spark, sf_dir, "events").select(page.alias("page"), target.alias("target"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 9).cast("string")).alias("anchor"), F.col("event_id").alias("ordinal"))
    return crawl.followups(links, ["view", "click"], ["3"], 4)


_FORMS = "SELECT 'http://X.org/l?b=1 2&__ycl_page=9&c' AS url, 'f ' || (user_id % 5) AS form, 'PAGE' AS field, CAST(event_id % 40 AS BIGINT) AS page, user_id % 5 = 0 AS goto FROM events"
_FORM_URL = "'http://x.org/l?b=1+2&c=&__ycl_kind=form&__ycl_form=f+' || substr(form, 3) || '&__ycl_field=PAGE&__ycl_page=' || page_index"


@QUERIES.add(
    f"""
    WITH a AS ({_FORMS}), g AS (SELECT form, max(page) AS total_pages, bool_or(goto) AS goto FROM a WHERE page > 0 GROUP BY form),
    p AS (SELECT DISTINCT g.form, total_pages, page AS page_index FROM g JOIN a ON a.form = g.form AND page > 0 AND NOT g.goto UNION SELECT form, total_pages, unnest(range(1, total_pages + 1)) FROM g WHERE goto)
    SELECT form, total_pages, page_index, {_FORM_URL} AS synthetic_url FROM p WHERE page_index > 1 AND page_index <> 7"""
)
def form_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as anchors of five forms; one of them has a box to go to a page."""
    form = F.concat(F.lit("f "), (F.col("user_id") % 5).cast("string"))
    anchors = table(spark, sf_dir, "events").select(F.lit("http://X.org/l?b=1 2&__ycl_page=9&c").alias("url"), form.alias("form"), F.lit("PAGE").alias("field"), (F.col("event_id") % 40).alias("page"), (F.col("user_id") % 5 == 0).alias("goto"))
    return crawl.form_pages(anchors, F.lit(7)).select("form", "total_pages", "page_index", "synthetic_url")


@QUERIES.add(
    """
    WITH a AS (SELECT user_id AS id, 'reported' AS origin, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id AS id, 'parsed' AS origin, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)"""
)
def pagination_states_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.lit(name).alias("origin"), F.count(F.lit(1)).alias("n"))
    return crawl.merged_states(of("view", "reported"), of("click", "parsed"), "id")


@QUERIES.add(f"WITH n AS ({_NODES}) SELECT count(*) AS total, count_if(status = 'pending') AS pending, 0::BIGINT AS in_progress, 0::BIGINT AS retry, count_if(status = 'done') AS done, 0::BIGINT AS failed, 0::BIGINT AS skipped FROM n")
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_summary(_nodes(spark, sf_dir))


_SITES = "['a.example.edu.cn', 'b.example.edu.cn', 'x.github.io', 'y.github.io', 'mp.weixin.qq.com', 'q.org', 'r.q.org', 'example.edu.cn']"


@QUERIES.add(
    f"""
    WITH u AS (SELECT event_id, {_SITES}[event_id % 8 + 1] AS h1, {_SITES}[user_id % 8 + 1] AS h2, event_id % 3 AS s, user_id % 2 AS t FROM events),
    r AS (SELECT *, CASE WHEN h1 LIKE '%.edu.cn' THEN array_to_string(list_slice(string_split(h1, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(h1, '.'), -2, -1), '.') END AS r1, CASE WHEN h2 LIKE '%.edu.cn' THEN array_to_string(list_slice(string_split(h2, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(h2, '.'), -2, -1), '.') END AS r2 FROM u),
    k AS (SELECT *, CASE WHEN h1 LIKE '%github.io' OR h2 LIKE '%github.io' THEN h1 = h2 ELSE r1 = r2 END AS same FROM r)
    SELECT event_id, r1 AS root, same AS same_site, h1 = h2 AND s = t AS matches, CASE WHEN h1 = 'mp.weixin.qq.com' THEN 'wechat' WHEN same THEN 'onsite' ELSE 'offsite' END AS redirect FROM k"""
)
def site_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of URLs on eight hosts: site roots, sameness, and redirects."""
    hosts = F.array(*map(F.lit, ["a.example.edu.cn", "b.example.edu.cn", "x.github.io", "y.github.io", "mp.weixin.qq.com", "q.org", "r.q.org", "example.edu.cn"]))
    pick = lambda c: F.element_at(hosts, (F.col(c) % 8 + 1).cast("int"))
    a = F.concat(F.lit("http://"), pick("event_id"), F.lit("/p/?b=2&a="), (F.col("event_id") % 3).cast("string"))
    b = F.concat(F.lit("https://"), pick("user_id"), F.lit("/p?a="), (F.col("user_id") % 2).cast("string"), F.lit("&b=2"))
    return table(spark, sf_dir, "events").select(
        "event_id", crawl.site_root(pick("event_id")).alias("root"), crawl.same_crawl_site(a, b).alias("same_site"), crawl.url_matches(a, b).alias("matches"), crawl.redirect_kind(a, b, ["mp.weixin.qq.com"]).alias("redirect")
    )


@QUERIES.add(
    """
    WITH o AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'rate_limited' WHEN 'error' THEN 'gateway' ELSE 'nav_error' END AS outcome, event_id % 7 + 1 AS attempt FROM events)
    SELECT event_id, CASE WHEN outcome = 'not_found' THEN 'skip' WHEN outcome = 'rate_limited' OR attempt >= 3 THEN 'fail' ELSE 'retry' END AS decision, least(2000.0::DOUBLE * pow(2.0, attempt - 1), 60000.0) AS wait_ms FROM o"""
)
def retry_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, attempt = F.col("event_type"), F.col("event_id") % 7 + 1
    outcome = F.when(kind == "view", "not_found").when(kind == "click", "rate_limited").when(kind == "error", "gateway").otherwise("nav_error")
    return table(spark, sf_dir, "events").select("event_id", crawl.funnel(outcome, attempt).alias("decision"), crawl.backoff_ms(attempt).alias("wait_ms"))


@QUERIES.add(
    """
    SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS title, arg_min(bio, o_orderkey) FILTER (WHERE bio <> '') AS bio FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '' END AS bio FROM orders) GROUP BY o_custkey"""
)
def filled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finds of a person: the first value that is there stays."""
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    bio = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, "")
    return crawl.filled(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", status.alias("title"), bio.alias("bio")), "o_custkey", ["o_orderkey"], ["title", "bio"])


@QUERIES.add()
def saved_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finds of persons: customers share names in a unit, few mails and pages."""
    key = F.col("o_orderkey")
    some = lambda n, m, p: F.when(key % n == 0, F.concat(F.lit(p), (F.col("o_custkey") % m).cast("string")))
    found = table(spark, sf_dir, "orders").select(key.alias("row"), (key % 5).alias("unit"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name_key"), some(4, 997, "m").alias("email"), some(7, 991, "h").alias("homepage"), some(11, 983, "l").alias("link"))
    return crawl.save_people(found)

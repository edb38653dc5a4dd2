"""Queries of stored tables, queues, nested outputs and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import noise, text
from siltstone.functions.hashing import hash_parts
from siltstone.operators import gold, nested, records, safety, sampling
from siltstone.plans.registry import Registry, table
from siltstone.sources.tables import VersionedTable
from siltstone.storage import fresh_path, spread
from siltstone.streaming import queue

QUERIES = Registry()
KINDS = {"purchase": "add", "signup": "add", "view": "claim", "click": "ok", "error": "error"}


@QUERIES.add(
    """
    WITH o AS (SELECT o_orderpriority, o_orderkey, o_totalprice, o_custkey FROM orders),
    changed AS (SELECT o_orderpriority, o_orderkey, 0.0::DOUBLE AS o_totalprice, o_custkey FROM o JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      UNION ALL SELECT '1-URGENT', -s_suppkey, s_acctbal, NULL FROM supplier),
    merged AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.o_orderpriority = o.o_orderpriority AND c.o_orderkey = o.o_orderkey) UNION ALL SELECT * FROM changed),
    rebuilt AS (SELECT o_orderpriority, o_custkey AS o_orderkey, sum(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey FROM o WHERE o_orderpriority = '3-MEDIUM' GROUP BY 1, 2)
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS least, max(o_custkey) AS greatest
    FROM (SELECT * FROM merged WHERE o_orderpriority NOT IN ('3-MEDIUM', '5-LOW') UNION ALL SELECT * FROM rebuilt) GROUP BY 1"""
)
def versioned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in partitions by priority: two are merged with changes and new rows, one is rebuilt, one deleted, one left alone."""
    price, key = F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderkey").cast("long").alias("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", key, price, F.col("o_custkey").cast("long").alias("o_custkey"))
    stored = VersionedTable(spark, fresh_path(spark, "orders"), "o_orderpriority")
    stored.replace(orders)
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("o_custkey"))
    changed = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(poor, "o_custkey", "left_semi").withColumn("o_totalprice", F.lit(0.0))
    new = table(spark, sf_dir, "supplier").select(F.lit("1-URGENT").alias("o_orderpriority"), (-F.col("s_suppkey")).cast("long").alias("o_orderkey"), F.col("s_acctbal").cast("double").alias("o_totalprice"), F.lit(None).cast("long").alias("o_custkey"))
    stored.merge(changed.select(orders.columns).unionByName(new), ["o_orderpriority", "o_orderkey"])
    medium = stored.read(partitions=["3-MEDIUM"]).groupBy("o_orderpriority", F.col("o_custkey").alias("o_orderkey")).agg(F.sum("o_totalprice").alias("o_totalprice"), F.max("o_custkey").alias("o_custkey"))
    stored.replace(medium, ["3-MEDIUM"])
    stored.delete(["5-LOW"])
    return stored.read().groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("least"), F.max("o_custkey").alias("greatest"))


@QUERIES.add()
def timed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of ten work queues that events drive: purchases and signups add a user's work of the day, views claim work, clicks and errors finish it."""
    events = table(spark, sf_dir, "events")
    kinds = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type"))
    item = F.when(kinds != "claim", F.concat_ws("/", "user_id", F.to_date("ts")))
    number = F.when(kinds == "add", F.col("user_id") % 5).otherwise(3)
    commands = events.select((F.col("user_id") % 10).alias("queue"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kinds.alias("kind"), item.alias("item"), number.alias("number"))
    return queue.changes(commands, lease=7_200.0)


_TREE = """o.o_orderkey, '{"lines":[' || string_agg('{"mode":"' || l_linestatus || '","note":{"flag":"' || l_returnflag || '","number":' || l_linenumber || '}}', ',' ORDER BY l_linenumber, l_linestatus, l_returnflag) || '],"priority":"' || o_orderpriority || '","tags":["' || o_orderstatus || '",null,[]]}'"""


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text an order, with its lines in a list."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_linestatus").alias("mode"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("number")).alias("note")).alias("line"))
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"))
    of = table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
    whole = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("lines.line").alias("lines")))
    tags = F.concat(F.lit(',"tags":["'), "o_orderstatus", F.lit('",null,[]]}'))
    return of.select("o_orderkey", F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), tags).alias("tree"))


@QUERIES.add(
    """
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag) - 1 AS n FROM lineitem)
    SELECT l_orderkey AS o_orderkey, '.lines[' || n || '].mode' AS path, l_linestatus AS text FROM l UNION ALL SELECT l_orderkey, '.lines[' || n || '].note.flag', l_returnflag FROM l
    UNION ALL SELECT o_orderkey, '.priority', o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, '.tags[0]', o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
)
def nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of the orders' trees, with their paths."""
    found = nested.strings(_trees(spark, sf_dir), "o_orderkey", "tree")
    return found.select("o_orderkey", nested.shown(F.col("path")).alias("path"), "text")


@QUERIES.add(f"SELECT o_orderkey, replace(replace(tree, '-URG', ''), 'F', '') AS tree FROM (SELECT {_TREE} AS tree FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o.o_orderkey, o_orderpriority, o_orderstatus)")
def nested_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' trees with fragments taken out of their texts, in the same shape."""
    return nested.without(_trees(spark, sf_dir), "o_orderkey", "tree", ["-URG", "F"])


#: What is planted in the first two turns of conversations, by conv_id modulo their number.
PLANTED = ["", "导师不行", "professor 很废物", "推翻政府", "裸照", "打死", "蠢货", "代做", "录取概率 Offer 概率", "往届 去年", "a.b@c.org", "call 13912345678", "2024 竞赛分析报告目录", "教育部白名单", "MENTOR 攻击", "老师", "人渣"]


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    phrase = F.element_at(F.array(*map(F.lit, PLANTED)), (F.pmod("conv_id", F.lit(len(PLANTED))) + 1).cast("int"))
    return turns.withColumn("text", F.when(F.col("turn") < 2, F.concat("text", F.lit(" "), phrase)).otherwise(F.col("text")))


def _met(c: safety.Category) -> str:
    some = lambda terms: "(" + (" OR ".join(f"contains(t, '{x.lower()}')" for x in terms) or "false") + ")"
    return some(c.terms) + (f" OR ({some(c.subjects)} AND {some(c.attacks)})" if c.subjects else "")


@QUERIES.add(
    f"""
    WITH p AS (SELECT conv_id, lower(coalesce(text, '') || CASE WHEN turn < 2 THEN ' ' || {PLANTED}[conv_id % {len(PLANTED)} + 1] ELSE '' END) AS t FROM conversations),
    m AS (SELECT conv_id, min(CASE {' '.join(f"WHEN {_met(c)} THEN {i}" for i, c in enumerate(safety.RULES.categories.values()))} END) AS place FROM p GROUP BY conv_id)
    SELECT conv_id, {list(safety.RULES.categories)}[place + 1] AS category FROM m"""
)
def safety_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first policy category that a conversation meets, phrases planted in its first turns."""
    folded = sorted({t.lower() for c in safety.RULES.categories.values() for t in (*c.terms, *c.subjects, *c.attacks)})
    found = _planted(spark, sf_dir).withColumn("found", safety.terms_in(F.col("text"), folded, lower=True))
    names = F.array(*map(F.lit, safety.RULES.categories))
    place = found.groupBy("conv_id").agg(F.min(safety.category(F.col("found"), F.lit(False))).alias("place"))
    return place.select("conv_id", F.when(F.col("place").isNotNull(), F.get(names, F.col("place"))).alias("category"))


@QUERIES.add()
def safety_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a result: user turns are its claims, assistant turns its output."""
    turns = _planted(spark, sf_dir)
    user = F.col("role") == "user"
    listed = lambda which, value: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("turn", value.alias("v"))))), lambda x: x["v"])
    claim = F.struct(F.when(F.col("turn") % 4 == 0, "fact").otherwise("advice").alias("kind"), F.col("text").alias("text"))
    results = turns.groupBy("conv_id").agg(listed(user, claim).alias("claims"), listed(~user, F.col("text")).alias("texts"))
    domain = F.when(F.col("conv_id") % 2 == 0, "competition").otherwise("generic")
    return safety.inspect(results.select("conv_id", domain.alias("domain"), F.lit(None).cast("string").alias("subject_kind"), (F.col("conv_id") % 3 == 0).alias("include_contacts"), "claims", "texts"), "conv_id")


@QUERIES.add()
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the customers: all of one nation, three of every other and ten of each stratum, the rest by digest."""
    customers = table(spark, sf_dir, "customer")
    flags = {"debt": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 9000, "building": F.col("c_mktsegment") == "BUILDING", "third": F.col("c_custkey") % 3 == 0}
    strata = F.filter(F.array(*(F.when(when, F.lit(name)) for name, when in flags.items())), lambda x: x.isNotNull())
    rows = customers.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), strata.alias("strata"), F.sha2(F.concat(F.lit("gold/"), F.col("c_custkey").cast("string")).cast("binary"), 256).alias("draw"))
    return sampling.quota_sample(rows, "c_custkey", "nation", "strata", "draw", customers.count() // 2, 1, 10, ("7",)).select("c_custkey", "nation", "why")


@QUERIES.add()
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without footers, headers, drawings and styles."""
    pages = table(spark, sf_dir, "pages").withColumn("s", noise.without_noise(F.col("html")))
    return pages.select("page_id", F.col("s.removed").cast("long").alias("removed"), F.length("s.html").cast("long").alias("n_chars"), F.sha2(F.col("s.html").cast("binary"), 256).alias("html_sha256"))


@QUERIES.add(
    """
    SELECT c_custkey, c_name AS name, c_mktsegment || ' ' || c_nationkey AS title, CASE WHEN c_custkey % 4 = 0 THEN '7' END AS phone, NULL AS bio, 'None x' AS enrollment_pref, c_mktsegment || '；' || c_nationkey AS research_areas,
      CASE WHEN c_custkey % 5 > 0 THEN 'p1；p2' END AS publications, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@x.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'HTTP://x.org/' || c_custkey END AS homepage, NULL AS external_link
    FROM customer WHERE c_custkey % 10 <> 1"""
)
def sanitized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of a model, some fields lists, numbers, blanks or no addresses."""
    key, every = F.col("c_custkey"), spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    quoted = lambda x: nested.quoted(x)
    fields = {
        "name": quoted(F.when(key % 10 != 1, F.concat(F.lit(" "), "c_name", F.lit("\n "))).otherwise("  ")),
        "title": F.concat(F.lit("["), quoted(F.col("c_mktsegment")), F.lit(","), "c_nationkey", F.lit("]")),
        "phone": F.when(key % 4 == 0, "7").otherwise("null"),
        "enrollment_pref": F.lit('[null," x "]'),
        "research_areas": quoted(F.concat("c_mktsegment", F.lit("; "), "c_mktsegment", F.lit(" ，"), "c_nationkey", F.lit("、"))),
        "publications": F.when(key % 5 > 0, '["p1","p2 ",""," p1"]').otherwise('[" "]'),
        "email": quoted(F.when(key % 3 == 0, F.concat(F.lit("c"), key, F.lit("@x.org"))).otherwise("no mail@x")),
        "homepage": quoted(F.when(key % 2 == 0, F.concat(F.lit("HTTP://x.org/"), key)).otherwise("ftp://x")),
    }
    raw = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items())), F.lit("}"))
    return records.sanitized(every.select("c_custkey", raw.alias("raw")), "c_custkey", "raw")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "； ")
    research = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("研究方向：(1) "), said).alias("research"))
    people = table(spark, sf_dir, "customer").join(research, "c_custkey", "left")
    key, named = F.col("c_custkey"), lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return people.select(F.lit("b").alias("build_id"), named("e", key).alias("entity_id"), named("o", key).alias("observation_id"), named("n", F.col("c_nationkey")).alias("university_id"), "research", F.array("c_mktsegment").alias("units"), F.when(key % 2 == 0, named("d", key)).alias("document_id"))


_FACTS = """
    p AS (SELECT 'e' || c_custkey AS e, 'o' || c_custkey AS o, 'n' || c_nationkey AS u, c_mktsegment AS m, c_custkey AS k FROM customer), s AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS t FROM orders),
    i AS (SELECT e, sha256(e || chr(0) || o || chr(0) || t) AS id FROM p JOIN s USING (k)),
    f AS (SELECT 'node:Professor' AS partition, e AS row_key FROM p UNION SELECT 'node:University', u FROM p UNION SELECT 'node:OrgUnit', m FROM p UNION SELECT 'rel:AFFILIATED_WITH', 'b:' || e || '|b:' || m FROM p UNION SELECT 'rel:PART_OF', 'b:' || m || '|b:' || u FROM p
      UNION SELECT 'node:ResearchStatement', id FROM i UNION SELECT 'rel:HAS_RESEARCH_STATEMENT', 'b:' || e || '|b:' || id FROM i UNION SELECT 'node:SourceDocument', 'd' || k FROM p WHERE k % 2 = 0 UNION SELECT 'rel:OBSERVED_IN', 'b:' || e || '|b:d' || k FROM p WHERE k % 2 = 0)"""


@QUERIES.add(f"WITH {_FACTS} SELECT * FROM f")
def expected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that customers with their orders' priorities for statements must lead to."""
    return gold.expected_facts(_people(spark, sf_dir))


@QUERIES.add(
    f"WITH {_FACTS}, a AS (SELECT * FROM f WHERE NOT (partition = 'rel:OBSERVED_IN' AND row_key LIKE '%0') UNION SELECT 'node:Topic', r_name FROM region) SELECT coalesce(f.partition, a.partition) AS partition, coalesce(f.row_key, a.row_key) AS row_key, CASE WHEN a.row_key IS NULL THEN 'missing' ELSE 'unexpected' END AS difference FROM f FULL JOIN a ON a.partition = f.partition AND a.row_key = f.row_key WHERE f.row_key IS NULL OR a.row_key IS NULL"
)
def fact_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts against an export by the other splitter, in which some are lost and some are strangers."""
    people = _people(spark, sf_dir)
    own = people.select("entity_id", "observation_id", F.explode(text.statements(F.col("research"))).alias("s"))
    ids = own.select("entity_id", hash_parts(F.col("entity_id"), F.col("observation_id"), F.col("s.text")).alias("id"))
    said = ids.select(F.lit("node:ResearchStatement").alias("partition"), F.col("id").alias("row_key")).unionByName(ids.select(F.lit("rel:HAS_RESEARCH_STATEMENT").alias("partition"), F.concat(F.lit("b:"), "entity_id", F.lit("|b:"), "id").alias("row_key")))
    facts = gold.expected_facts(people)
    others = facts.where("partition NOT IN ('node:ResearchStatement', 'rel:HAS_RESEARCH_STATEMENT') AND NOT (partition = 'rel:OBSERVED_IN' AND row_key LIKE '%0')")
    strange = table(spark, sf_dir, "region").select(F.lit("node:Topic").alias("partition"), F.col("r_name").alias("row_key"))
    return gold.fact_differences(facts, others.unionByName(said).unionByName(strange))

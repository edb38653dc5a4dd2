import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.operators import frontier, graph, grounding, planning, relational, resolution, retrieval
from siltstone.sources import files, pages, sqlite


def rows(df):
    return sorted(tuple(r) for r in df.collect())


OBS = "observation_id string, source_ordinal long, university_id string, org_unit_id string, name_key string, source_url string, page_kind string, external_link string, email string"


def observation(i, name="n", url=None, kind="unknown", org=None, link=None, email=None):
    return (f"o{i}", i, "u", org, name, url, kind, link, email)


def assigned(spark, obs, history=None):
    h = spark.createDataFrame(history, "observation_id string, entity_id string") if history else None
    out = {r.observation_id: r for r in resolution.assign_entities(spark.createDataFrame(obs, OBS), h).collect()}
    return [out[o[0]] for o in obs]


def test_same_name_at_two_listings_is_a_conflict(spark):
    a, b = assigned(spark, [observation(1, url="https://x/1", org="7"), observation(2, url="https://x/2", org="7")])
    assert a.entity_id != b.entity_id and (a.method, b.method, b.finding) == ("new", "review", "identity_conflict")


def test_one_orcid_is_one_person_whatever_the_email(spark):
    link = "https://orcid.org/0000-0001-2345-6789"
    a, b = assigned(spark, [observation(1, "p", link=link, email="a@x.cn"), observation(2, "q", link=link, email="b@x.cn")])
    assert a.entity_id == b.entity_id and b.method == "strong" and b.score == 1.0


def test_a_shared_email_merges_nobody(spark):
    a, b = assigned(spark, [observation(1, "p", org="1", email="a@x.cn"), observation(2, "q", org="2", email="a@x.cn")])
    assert a.entity_id != b.entity_id and (a.method, b.method) == ("new", "new")


def test_strong_claims_of_two_persons_collide(spark):
    one, two = "https://orcid.org/0000-0001-2345-6789", "https://orcid.org/0000-0009-2345-6789"
    obs = [observation(1, "p", "https://x/p", "single_profile", link=one), observation(2, "q", link=two), observation(3, "p", "https://x/p", "single_profile", link=two)]
    a, b, c = assigned(spark, obs)
    assert len({a.entity_id, b.entity_id, c.entity_id}) == 3 and c.finding == "strong_claim_collision"


def test_history_keeps_its_entity_and_weak_claims_join(spark):
    a, b, c = assigned(spark, [observation(1, org="1"), observation(2, org="1"), observation(3, "z")], [("o1", "old")])
    assert (a.entity_id, a.method) == ("old", "reused") and (b.entity_id, b.method, b.score) == ("old", "weak", 0.8) and c.method == "new"


def test_roles(spark):
    data = [("讲师", ["硕导"], []), ("工程师", [], ["实验室管理人员"]), ("实验师", [], []), ("", ["博导", "非博导"], []), (None, ["非博导"], []), ("特聘副教授", [], [])]
    out = resolution.classify_roles(spark.createDataFrame(data, "t string, e array<string>, c array<string>"), "t", "e", "c").collect()
    assert [(r.role_status, r.title_family, r.phd) for r in out] == [
        ("included", "lecturer", "unknown"), ("excluded", "technical", "unknown"), ("review", "technical", "unknown"),
        ("included", "unknown", "conflict"), ("review", "unknown", "unknown"), ("included", "associate", "unknown"),
    ]


def test_complete_link_does_not_chain(spark):
    pairs = [("k", 1, 2, 0.95), ("k", 2, 3, 0.9), ("k", 4, 5, 0.9)]
    df = spark.createDataFrame(pairs + [(k, b, a, s) for k, a, b, s in pairs] + [("k", 6, 7, 0.99)], "kind string, a long, b long, score double")
    assert rows(resolution.complete_link(df, 0.8)) == [("k", [1, 2], 0.95), ("k", [4, 5], 0.9)]


def test_budgets(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([500, 80, 200, 10])], "k long, i long, n long")
    assert [r[1] for r in rows(relational.within_budget(df, ["k"], [F.col("i")], F.col("n"), 600, 5))] == [0, 1]
    facts = spark.createDataFrame([(1, 0, "x" * 40), (1, 1, "y" * 400), (1, 2, "z" * 20), (1, 3, "HIT " + "w" * 400), (1, 4, "a@b.cn hit"), (2, 0, "v" * 60)], "subject_id long, ordinal long, value string")
    assert [r[:2] for r in rows(grounding.trim_facts(facts, 15, ["hit"]).select("subject_id", "ordinal"))] == [(1, 0), (1, 2), (1, 3), (2, 0)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (5, 7)], "child long, parent long")
    assert rows(graph.cycle_edges(edges)) == [(1, 2), (2, 3), (3, 1)]
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4)], "id long, into long")
    assert rows(graph.resolve_merges(chain)) == [(1, 4), (2, 4), (3, 4), (9, 4)]
    with pytest.raises(ValueError):
        graph.resolve_merges(spark.createDataFrame([(1, 2), (2, 1)], "id long, into long"), most=4)
    assert dict(rows(graph.connected_components(edges.toDF("src", "dst")))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5}


def test_manifest_lists_empty_partitions_and_ignores_order(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "p string, k string, v string")
    every = spark.createDataFrame([("a",), ("b",)], "p string")
    make = lambda d: {r.p: r for r in relational.manifest(d, "p", F.col("k"), F.col("v"), every).collect()}
    out = make(df)
    assert out["b"].row_count == 0 and out["a"].row_count == 2 and out == make(df.orderBy(F.desc("k")))
    assert out["a"].checksum != make(df.withColumn("v", F.lit("z")))["a"].checksum


def test_retrieval_metrics(spark):
    found = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "q string, d string, rank int")
    judged = spark.createDataFrame([("q", "a", 2), ("q", "b", 0), ("q", "c", 1)], "q string, d string, grade int")
    r = retrieval.retrieval_metrics(found, judged, "q", "d").first()
    assert r.recall_at_20 == 0.5 and 0 < r.ndcg_at_10 < 1 and not r.none_in_ten


def test_claims(spark):
    ref = lambda c: {"doc_path": "d", "heading_path": "h", "chunk_hash": c}
    data = [(1, "fact", []), (2, "fact", [ref("x")]), (3, "fact", [ref("x"), ref("no")]), (4, "advice", [ref("x"), ref("no"), ref("x")]), (5, "uncertain", [ref("x")])]
    claims = spark.createDataFrame(data, "claim_id long, kind string, refs array<struct<doc_path:string,heading_path:string,chunk_hash:string>>")
    out = grounding.validate_claims(claims, spark.createDataFrame([("d", "h", "x")], "doc_path string, heading_path string, chunk_hash string"))
    assert [(r.claim_id, r.status, len(r.refs)) for r in sorted(out.collect())] == [(1, "uncertain", 0), (2, "kept", 1), (3, "dropped", 0), (4, "kept", 1), (5, "uncertain", 0)]


def test_frontier(spark):
    nodes = spark.createDataFrame([(1, "pending", "http://a/x"), (2, "done", "https://a/x"), (3, "pending", "http://a/y")], "id long, status string, url string")
    edges = spark.createDataFrame([(1, 3, "l"), (2, 3, "l"), (1, 2, "l")], "src long, dst long, kind string")
    left, moved = frontier.collapse_twins(nodes, edges, F.regexp_replace("url", "^https?://", ""))
    assert [r[0] for r in rows(left)] == [2, 3] and rows(moved) == [(2, 3, "l")]
    old = spark.createDataFrame([("a", "done", 2, 1.0, None, {"k": "old"})], "node_key string, status string, attempts int, priority double, owner string, metadata map<string,string>")
    new = spark.createDataFrame([("a", 5.0, "o", {"k": "new", "m": "1"}), ("b", 2.0, None, None)], "node_key string, priority double, owner string, metadata map<string,string>")
    out = {r.node_key: r for r in frontier.merge_nodes(old, new).collect()}
    assert (out["a"].status, out["a"].attempts, out["a"].priority, out["a"].owner, out["a"].metadata) == ("done", 2, 5.0, "o", {"k": "old", "m": "1"})
    assert out["b"].status == "pending"


def test_plans(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([1.0, 1.0, 8.0])] + [(2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)], "plan_id long, ordinal long, weight double")
    days = F.when(F.col("plan_id") == 1, 10).otherwise(2)
    df = df.withColumn("start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.date_add("start_date", days - 1))
    out = [(r.plan_id, r.ordinal, r.start.day, r.end.day) for r in sorted(planning.allocate(df).collect())]
    assert out == [(1, 0, 1, 1), (1, 1, 2, 2), (1, 2, 3, 10)]  # the second plan has fewer days than phases


def test_markdown(spark):
    body = "# A\n\nintro\n## B\n```\n# no heading\n```\nsee https://x.y/z\n## C\n\n# D\ntext last verified: 2024-05-06"
    df = spark.createDataFrame([("f.md", body)], "doc_path string, text string")
    out = [(r.heading_path, r.text, r.links, r.last_verified) for r in sorted(files.markdown_chunks(df).collect(), key=lambda r: r.ordinal)]
    assert [x[0] for x in out] == ["A", "A > B", "D"]
    assert out[1][1] == "```\n# no heading\n```\nsee https://x.y/z" and out[1][2] == ["https://x.y/z"] and out[2][3] == "2024-05-06"


def test_page_links(spark):
    html = "<title>T</title><nav class='n'><a href='/a/'>A</a></nav><h2>People</h2><p><a href='https://other.org/b'>B</a> <a href='/a/'>again</a>"
    links = pages.link_signals(spark.createDataFrame([(1, "https://x.edu/l", html)], "page_id long, url string, html string"))
    assert rows(links.select("target", "anchor", "heading", "near_class", "same_site")) == [("https://other.org/b", "B", "People", "", False), ("https://x.edu/a", "A", "", "n", True)]


def test_sqlite_files_and_snapshots(spark, tmp_path):
    for i in range(2):
        with sqlite3.connect(tmp_path / f"u{i}.db") as db:
            db.execute(f"create table professors (id integer, name text{', email text' if i else ''})")
            db.execute("insert into professors (id, name) values (?, ?)", (i, f"n{i}"))
    df = sqlite.read_sqlite(spark, str(tmp_path), "professors")
    assert rows(df.select("id", "name", "email")) == [(0, "n0", None), (1, "n1", None)]
    first = files.write_snapshot(df.drop("source_file"), str(tmp_path / "s"), "id")
    assert files.write_snapshot(df.drop("source_file"), str(tmp_path / "s"), "id") == first and spark.read.parquet(first).count() == 2
    where = str(tmp_path / "active")
    assert files.active(spark, where) is None
    files.promote(spark, where, "v1")
    files.promote(spark, where, "v2")
    assert files.active(spark, where) == "v2"
    (tmp_path / "active" / "at=3").mkdir()  # a promotion that never ended
    assert files.active(spark, where) == "v2"
    files.promote(spark, where, "v3")
    assert files.active(spark, where) == "v3"

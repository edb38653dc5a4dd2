import pytest
from pyspark.sql import functions as F

from siltstone.functions import repair
from siltstone.operators import recommend


@pytest.mark.parametrize("text, want", [("ä¸\xadæ\x96\x87", "中文"), ("café", "café"), ("中文", "中文"), ("", ""), ("Ã©t", "ét"), ("é", "é"), (None, None)])
def test_mojibake(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(repair.repair_mojibake(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("name, want", [("计算机（ 软件", "计算机（软件）"), ("a) b", "a b"), ("  ", None), ("x (y）z", "x(yz)"), ("((a", "((a))"), (")", None), ("甲（乙(丙）丁", "甲（乙(丙丁)）"), (None, None)])
def test_brackets(spark, name, want):
    got = spark.createDataFrame([(name,)], "t string").select(repair.org_unit_name(F.col("t"))).first()[0]
    assert got is None and want is None or got.replace(" ", "") == want.replace(" ", "")


def test_cities_and_terms(spark):
    df = spark.createDataFrame([("北京市",), ("沙市",), ("",)], "c string")
    assert [tuple(r) for r in df.select(repair.city(F.col("c")), repair.city_matches(F.col("c"), ["北京"])).collect()] == [("北京", True), ("沙市", False), (None, None)]
    q = spark.createDataFrame([("我想 学习 AI 2024 学习",)], "q string")
    assert q.select(repair.query_terms(F.col("q"))).first()[0] == ["学习", "AI"]
    p = spark.createDataFrame([("http://x/teacher/1", "教授 研究方向 " + "x" * 200), ("http://x/news", "short")], "u string, t string")
    assert [r[0] for r in p.select(repair.missing_signs(F.col("u"), F.col("t"))).collect()] == ["", "text_too_short,url_not_homepage_like,no_rich_tokens,no_title_tokens"]


def test_rerank_caps_those_without_direction(spark):
    data = [
        ("q", "a", 0.9, ["graph"], [], [], ["t1"], "about graph learning", ["graph"], ["graphs"], "confirmed", "confirmed", "included", 5, 0, 1),
        ("q", "b", 1.0, ["graph"], [], [], [], "biology", ["cells"], [], "confirmed", "confirmed", "included", 5, 1, 1),
        ("r", "c", 1.0, [], [], ["t1"], ["t1"], None, [], [], "unknown", "unknown", "review", 0, 0, 0),
    ]
    schema = "query_id string, entity_id string, semantic double, query_terms array<string>, interests array<string>, anchor_topics array<string>, topic_ids array<string>, summary string, statements array<string>, topics array<string>, master string, phd string, role_status string, n_refs int, n_urls int, n_publications int"
    out = {r.entity_id: r for r in recommend.rerank(spark.createDataFrame(data, schema)).collect()}
    assert (out["a"].rank, out["b"].rank) == (1, 2) and out["b"].score == 0.34 and out["b"].level == "weak"
    assert out["a"].score == pytest.approx(0.45 + 0.18 + 0.08 + 0.08 + 0.04 * 0.8) and out["c"].score == pytest.approx(0.55)


def test_competition_components(spark):
    data = [("n", "c", ["建模"], [], [], ["建模"], ["数学"], "数学 论文", "", "", 12, "", "research", 0.1, 1, True)]
    schema = "name string, category string, tags array<string>, focus array<string>, risks array<string>, interests array<string>, hints array<string>, summary string, eligibility string, schedule string, weekly_hours int, time_window string, goal string, recall double, n_refs int, in_catalog boolean"
    r = recommend.competition_components(spark.createDataFrame(data, schema)).first()
    assert (r.interest, r.eligibility_score, r.effort, r.timeline, r.goal_score, r.provenance) == (1.0, 1.0, 1.0, 0.45, 1.0, 1.0)


def test_buckets(spark):
    df = spark.createDataFrame([(3.7, 4.0, 4), (None, None, None), (2.0, 4.0, 30)], "g double, s double, p int")
    assert [tuple(r) for r in df.select(recommend.gpa_bucket(F.col("g"), F.col("s")), recommend.rank_bucket(F.col("p"))).collect()] == [("top10", "top5"), (None, None), ("unknown", "medium")]

"""Recommendation: reranking of recalled candidates and scoring of competitions, as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.retrieval import weighted

#: Weights of the reranking's components, its boost, and its level thresholds.
WEIGHTS = {"semantic": 0.50, "topic": 0.18, "student_fit": 0.12, "eligibility": 0.08, "provenance": 0.08, "completeness": 0.04}
BOOST_PER_TOPIC, BOOST_MOST = 0.05, 0.15
LEVELS = {"excellent": 0.75, "strong": 0.55, "possible": 0.35}

#: Words that tell a demanding competition and the goals that a competition serves.
DEMANDING = ["长期", "系统", "工程", "答辩", "项目", "论文", "高强度"]
GOALS = {
    "learn": ["基础", "入门", "学习", "训练", "能力"],
    "portfolio": ["作品", "项目", "代码", "设计", "展示"],
    "school_recognition": ["本校", "认定", "目录", "报告"],
    "research": ["论文", "研究", "建模", "实验", "数据"],
    "job_skill": ["工程", "实践", "开发", "创新", "创业"],
}


def share_of_terms(terms: Column, text: Column) -> Column:
    """Share of an array of terms that a text holds, case aside; 0 without terms or text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    met = F.size(F.filter(terms, lambda t: (t != "") & F.contains(low, F.lower(t))))
    return F.when((F.size(terms) > 0) & (low != ""), F.least(F.lit(1.0), met / F.size(terms))).otherwise(0.0)


def match_level(score: Column) -> Column:
    out = F.lit("weak")
    for name, least in reversed(LEVELS.items()):
        out = F.when(score >= least, name).otherwise(out)
    return out


TIES = {"score": F.desc, "semantic": F.desc, "evidence_count": F.desc, "entity_id": F.asc}


def rerank(rows: DataFrame, query: str = "query_id", ties: Sequence[str] = tuple(TIES)) -> DataFrame:
    """Candidates with score, level and rank within their query, ranked by ``ties`` one after another.

    ``rows``: query_id, entity_id, semantic, query_terms, interests, anchor_topics, topic_ids (arrays),
    summary, statements and topics (arrays), master, phd, role_status, n_refs, n_urls,
    n_publications. If any candidate of a query has direct evidence of its direction, those
    without stay below the lowest level.
    """
    own = F.concat_ws(" ", "topics", "statements")
    told = F.concat_ws(" ", "summary", "statements")
    eligible = (F.when(F.col("master") == "confirmed", 0.5).otherwise(0.0) + F.when(F.col("phd") == "confirmed", 0.5).otherwise(0.0)) * F.when(F.col("role_status") == "review", 0.7).otherwise(1.0)
    evidence = F.coalesce("n_refs", F.lit(0)) + F.coalesce("n_urls", F.lit(0))
    there = [F.col("summary").isNotNull(), F.size("statements") > 0, F.size("topics") > 0, F.col("n_publications") > 0, F.col("n_urls") > 0]
    filled = F.lit(0)
    for t in there:
        filled = filled + F.coalesce(t, F.lit(False)).cast("int")
    parts = {
        "semantic": F.col("semantic"), "topic": share_of_terms(F.col("query_terms"), own), "student_fit": share_of_terms(F.col("interests"), told),
        "eligibility": eligible, "provenance": F.least(F.lit(1.0), evidence / 5.0), "completeness": filled / len(there),
    }
    overlap = F.size(F.array_intersect("topic_ids", "anchor_topics"))
    boost = F.when(F.size("anchor_topics") > 0, F.least(F.lit(BOOST_MOST), BOOST_PER_TOPIC * overlap)).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted({k: (v, WEIGHTS[k]) for k, v in parts.items()}) + boost))
    direction = share_of_terms(F.col("query_terms"), F.concat_ws(" ", "summary", "statements", "topics"))
    scored = rows.withColumn("evidence_count", evidence).withColumn("direction", direction).withColumn("raw", score)
    known = F.max("direction").over(Window.partitionBy(query)) > 0
    capped = F.when(known & (F.col("direction") <= 0), F.least("raw", F.lit(LEVELS["possible"] - 0.01))).otherwise(F.col("raw"))
    out = scored.withColumn("score", F.round(capped, 6)).withColumn("level", match_level(F.col("score")))
    order = [TIES[t](t) for t in ties]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).select(query, "entity_id", "score", "level", "direction", "evidence_count", "rank")


def _holds(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w.lower()))
    return out


def competition_components(rows: DataFrame) -> DataFrame:
    """``rows`` with interest, eligibility_score, effort, timeline, goal_score and provenance.

    ``rows``: name, category, tags, focus, risks, interests, hints (arrays), summary, eligibility,
    schedule, weekly_hours, time_window, goal, recall, n_refs, in_catalog; texts aren't null.
    """
    blob = F.concat_ws(" ", "name", "category", F.concat_ws(" ", "tags"), "summary")
    interest = F.when(F.size("interests") == 0, F.least(F.col("recall"), F.lit(1.0))).otherwise(F.least(F.lit(1.0), F.greatest("recall", share_of_terms(F.col("interests"), blob))))
    hints = F.filter("hints", lambda h: h.isNotNull() & (h != ""))
    said = F.col("eligibility") != ""
    fits = share_of_terms(hints, F.concat_ws(" ", "eligibility", "summary")) > 0
    eligibility = F.when(F.size(hints) == 0, F.when(said, 0.65).otherwise(0.45)).when(fits, 1.0).when(said, 0.6).otherwise(0.35)
    hard = _holds(F.concat_ws(" ", "summary", F.concat_ws(" ", "focus"), F.concat_ws(" ", "risks")), DEMANDING)
    h = F.col("weekly_hours")
    effort = (
        F.when(h.isNull(), F.when(hard, 0.55).otherwise(0.7)).when(hard, F.when(h >= 10, 1.0).when(h >= 5, 0.72).otherwise(0.42)).otherwise(F.when(h >= 3, 0.9).otherwise(0.62))
    )
    dated = F.col("schedule") != ""
    wish = F.coalesce("time_window", F.lit(""))
    timeline = F.when(wish == "", F.when(dated, 0.65).otherwise(0.45)).when(F.contains(F.lower("schedule"), F.lower(wish)), 1.0).when(dated, 0.55).otherwise(0.35)
    about = F.concat_ws(" ", "summary", F.concat_ws(" ", "focus"), "category")
    goal = F.lit(0.58)
    for name, words in GOALS.items():
        goal = F.when((F.col("goal") == name) & _holds(about, words), 1.0).otherwise(goal)
    goal = F.when(F.coalesce("goal", F.lit("")) == "", 0.65).otherwise(goal)
    provenance = F.when(F.col("n_refs") == 0, 0.2).when(F.col("in_catalog"), 1.0).otherwise(0.82)
    return rows.select("*", interest.alias("interest"), eligibility.alias("eligibility_score"), effort.alias("effort"), timeline.alias("timeline"), goal.alias("goal_score"), provenance.alias("provenance"))


def gpa_bucket(gpa: Column, scale: Column) -> Column:
    ratio = gpa / F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(4.0))
    return F.when(gpa.isNull(), None).when(ratio >= 0.9, "top10").when(ratio >= 0.85, "top25").when(ratio >= 0.8, "high").when(ratio >= 0.7, "medium").otherwise("unknown")


def rank_bucket(percent: Column) -> Column:
    return F.when(percent.isNull(), None).when(percent <= 5, "top5").when(percent <= 10, "top10").when(percent <= 25, "top25").otherwise("medium")


def adaptive_recall(hits: DataFrame, allowed: DataFrame, query: str, entity: str, limit: int) -> DataFrame:
    """The best ``limit`` hits of a query that the filters let through.

    Filtering before ranking is what widening the recall step by step comes to, in one pass.
    """
    kept = hits.join(allowed.select(entity).distinct(), entity, "left_semi")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.col(entity)))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit)

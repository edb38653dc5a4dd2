"""Repairs and classifications of crawled text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cities whose names may carry the sign for city, words of queries that tell nothing, tokens of profile pages.
MUNICIPALITIES = ["北京", "上海", "天津", "重庆"]
QUERY_STOPWORDS = ["我想", "推荐", "适合", "比赛", "竞赛", "一个", "一些", "有没有", "大学生", "参加", "准备", "希望"]
HOMEPAGE_TOKENS = ["teacher", "szdw", "info", "faculty", "people", "professor", "jsdw", "rcjs", "/show", "content"]
RICH_TOKENS = ["个人简介", "教育经历", "科研项目", "论文著作", "研究方向", "工作经历", "学习经历", "研究成果"]
TITLE_TOKENS = ["教授", "研究员", "院士", "副教授", "讲师", "助理教授"]
OPENING, CLOSING = "(（", ")）"


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; text that isn't that, or gains Latin-1 letters by it, stays."""
    latin = F.lit(r"[\x{80}-\x{FF}]")
    bytes_ = F.when(~text.rlike(r"[^\x{00}-\x{FF}]"), F.encode(text, "ISO-8859-1")).cast("string")
    again = F.when(F.is_valid_utf8(bytes_), bytes_)
    return F.when(F.regexp_count(again, latin) <= F.regexp_count(text, latin), again).otherwise(text)


def org_unit_name(name: Column) -> Column:
    """A name with closing brackets that nothing opened dropped and open ones closed; null if nothing is left.

    A fold over its signs: the text so far, and the closing signs that are due, the next one first.
    """
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("due"))

    def step(at: Column, sign: Column) -> Column:
        opens, closes = F.contains(F.lit(OPENING), sign) & (sign != ""), F.contains(F.lit(CLOSING), sign) & (sign != "")
        fits = F.substring(at["due"], 1, 1) == sign
        text = F.when(closes & ~fits, at["text"]).otherwise(F.concat(at["text"], sign))
        due = F.when(opens, F.concat(F.translate(sign, OPENING, CLOSING), at["due"])).when(closes & fits, F.substring(at["due"], 2, 1 << 20)).otherwise(at["due"])
        return F.struct(text.alias("text"), due.alias("due"))

    clean = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    tight = F.regexp_replace(clean(name), r" *([()（）]) *", "$1")
    whole = F.aggregate(F.split(tight, ""), start, step, lambda at: F.concat(at["text"], at["due"]))
    return F.nullif(clean(whole), F.lit(""))


def city(name: Column) -> Column:
    """A city without the sign for city where that is only a sign; null if empty."""
    clean = F.trim(name)
    bare = F.regexp_replace(clean, "市$", "")
    return F.when(clean == "", None).when(bare.isin(MUNICIPALITIES), bare).otherwise(clean)


def city_matches(name: Column, wanted: list[str]) -> Column:
    """Whether a city is among the wanted ones; null if it is unknown, true without wishes."""
    if not wanted:
        return F.lit(True)
    return F.when(city(name).isNotNull(), F.array_contains(F.transform(F.array(*map(F.lit, wanted)), city), city(name)))


def query_terms(text: Column) -> Column:
    """Words of two letters or more, without stop words and numbers, each once."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w{2,}"), 0)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(QUERY_STOPWORDS) & ~w.rlike(r"(?U)^\d+$")))


def missing_signs(url: Column, text: Column) -> Column:
    """What a page lacks to be a rich profile, joined by commas; empty if it is one and may be tried again."""
    any_of = lambda c, tokens: c.rlike("|".join(map(re.escape, tokens)))
    signs = [("text_too_short", F.length(text) >= 200), ("url_not_homepage_like", any_of(F.lower(url), HOMEPAGE_TOKENS)), ("no_rich_tokens", any_of(text, RICH_TOKENS)), ("no_title_tokens", any_of(text, TITLE_TOKENS))]
    return F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in signs])

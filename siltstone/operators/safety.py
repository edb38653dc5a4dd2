"""Rules on generated text: refused categories, unsafe advice, claims of probability, stale facts, contacts.

All terms of all rules are looked for in one pass over a text, by an automaton that a worker builds once. What the terms
mean for a result is column work on the terms found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    """A category is met by one of its terms, or by a subject and an attack in the same text."""

    terms: tuple[str, ...]
    subjects: tuple[str, ...] = ()
    attacks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    """``categories`` are tried in their order, whatever the case of letters; all other terms as they are written."""

    categories: dict[str, Category]
    unsafe: tuple[str, ...] = ()
    probability: tuple[str, ...] = ()
    stale: tuple[str, ...] = ()
    contacts: tuple[str, ...] = ()
    mislabel: tuple[str, str, str] | None = None  # two phrases that must not stand together in an output, and what is said of it
    refusal: str = ""
    mark: str = "[uncertain]"
    stale_domains: tuple[str, ...] = field(default=("competition",))


#: The terms and messages that results must agree on, in the order in which categories are tried.
RULES = Rules(
    categories={
        "mentor_attack": Category(
            ("攻击导师", "侮辱导师", "骂导师", "导师垃圾", "导师很垃圾", "导师人品差", "导师不行", "避雷导师"),
            ("导师", "教授", "老师", "mentor", "professor"),
            ("垃圾", "傻逼", "废物", "人渣", "人品差", "不行", "避雷", "骂", "侮辱", "攻击", "贬低", "嘲讽"),
        ),
        "political_sensitive": Category(("政治敏感", "敏感政治", "政治攻击", "推翻政府", "煽动颠覆", "国家领导人", "党和国家")),
        "sexual_content": Category(("色情", "黄图", "裸照", "性行为", "性暗示", "三级片")),
        "violent_content": Category(("暴力", "打死", "杀死", "砍死", "伤害他", "伤害她", "血腥")),
        "personal_attack": Category(("人身攻击", "傻逼", "垃圾", "废物", "人渣", "弱智", "蠢货", "侮辱他", "骂他", "骂她")),
    },
    unsafe=("代做", "挂名", "伪造数据", "赛中泄题", "绕过查重", "规避 AI 披露", "规避AI披露"),
    probability=("录取概率", "保研概率", "奖学金概率", "综测加分", "Offer 概率", "获奖概率", "导师接收意愿", "导师接收你的意愿", "录用意愿", "导师愿意接收"),
    stale=("2024 年报名", "2024年报名", "往届", "去年", "上一届"),
    contacts=(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"1[3-9]\d{9}"),
    mislabel=("2024 竞赛分析报告目录", "教育部白名单", "2024 report dir mislabelled as 教育部白名单"),
    refusal="我不能生成或传播政治敏感、人身攻击、色情暴力或攻击导师的内容。可以改为基于公开事实讨论研究方向、招生信息、沟通策略、学习规划或礼貌沟通措辞。",
    mark="[uncertain: 往届信息]",
)


def _listed(rules: Rules) -> tuple[list[str], list[str]]:
    """Terms that are looked for in lower-cased texts, and those looked for in texts as they are."""
    folded = sorted({t.lower() for c in rules.categories.values() for t in (*c.terms, *c.subjects, *c.attacks) if t})
    return folded, sorted({t for t in (*rules.unsafe, *rules.probability, *rules.stale, *(rules.mislabel or ())[:2]) if t})


@lru_cache(8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    found.make_automaton()
    return found


def terms_in(text: Column, terms: list[str], lower: bool = False) -> Column:
    """The distinct ``terms`` that occur in a text, sorted: one pass over it, however many there are. Null has none."""
    listed = tuple(terms)

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(listed) if listed else None
        for part in parts:
            texts = (x.as_py() or "" for x in part)
            yield pa.array([sorted({t for _, t in automaton.iter(x.lower() if lower else x)}) if automaton else [] for x in texts], pa.list_(pa.string()))

    return run(text)


def _any(found: Column, terms) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, terms))) if terms else F.lit(False)


def category(found: Column, mentor: Column, rules: Rules = RULES) -> Column:
    """Place in the order of categories of the first that the lower-cased terms of one text meet; null for none."""
    met = F.lit(None).cast("int")
    for at, c in reversed(list(enumerate(rules.categories.values()))):
        low = lambda terms: [t.lower() for t in terms]
        both = (mentor | _any(found, low(c.subjects))) & _any(found, low(c.attacks)) if c.subjects and c.attacks else F.lit(False)
        met = F.when(_any(found, low(c.terms)) | both, at).otherwise(met)
    return met


def _without_contacts(text: Column, rules: Rules) -> Column:
    for pattern in rules.contacts:
        text = F.regexp_replace(text, pattern, "")
    return text


def inspect(results: DataFrame, key: str, rules: Rules = RULES) -> DataFrame:
    """(key, status, category, warnings, claims, texts) of ``results``.

    These have the key, domain, subject_kind, include_contacts, claims (array of kind and text) and texts (the string leaves of the output). A result that meets a category is
    refused: no claims, and the refusal for a text. Unsafe advice, or phrases that mislabel, empties the output. Else
    claims and phrases of probability go, stale facts become uncertain and are marked, contacts go unless they may be there; if a contact is left the output is empty. ``status``: refused, emptied or passed.
    ``warnings``: array of (code, about). Texts of a result are judged each by itself, but for mislabelling. Null texts are empty. Null include_contacts is false. A key is one result.
    """
    folded, exact = _listed(rules)
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    claim, code = "array<struct<kind:string,text:string>>", "array<struct<code:string,about:string>>"
    rows = results.select(key, F.coalesce("domain", F.lit("")).alias("domain"), (F.coalesce("subject_kind", F.lit("")) == "mentor").alias("mentor"), F.coalesce("include_contacts", F.lit(False)).alias("may"), empty("claims", claim).alias("claims"), empty("texts", "array<string>").alias("texts"))
    said = F.transform("claims", lambda c: F.struct(F.lit(True).alias("claim"), c["kind"].alias("kind"), F.coalesce(c["text"], F.lit("")).alias("text")))
    shown = F.transform("texts", lambda t: F.struct(F.lit(False).alias("claim"), F.lit(None).cast("string").alias("kind"), F.coalesce(t, F.lit("")).alias("text")))
    each = rows.select(key, "domain", "mentor", "may", F.posexplode_outer(F.concat(said, shown)).alias("at", "x")).select(key, "domain", "mentor", "may", "at", "x.*")
    each = each.withColumn("low", terms_in(F.lower("text"), folded, lower=True)).withColumn("own", terms_in(F.col("text"), exact))
    contact = F.lit(False)
    for pattern in rules.contacts:
        contact = contact | F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    each = each.withColumn("category", category(F.col("low"), F.col("mentor"), rules)).withColumn("contact", contact)
    pair = list((rules.mislabel or ())[:2])
    row = F.struct("at", "claim", "kind", "text", "own")
    per = each.groupBy(key).agg(
        *(F.first(c).alias(c) for c in ("domain", "may")),
        F.min("category").alias("category"),
        F.min_by("text", F.when(_any(F.col("own"), rules.unsafe), F.col("at"))).alias("unsafe"),
        F.max(F.when(~F.col("claim"), F.array_contains("own", pair[0])).otherwise(False)).alias("one") if pair else F.lit(False).alias("one"),
        F.max(F.when(~F.col("claim"), F.array_contains("own", pair[1])).otherwise(False)).alias("two") if pair else F.lit(False).alias("two"),
        F.max("contact").alias("contact"),
        F.array_distinct(F.flatten(F.collect_list("own"))).alias("terms"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), row))).alias("rows"),
    )
    names = F.array(*map(F.lit, rules.categories))
    mislabelled = F.coalesce(F.col("one") & F.col("two"), F.lit(False))
    stale_here = F.col("domain").isin(*rules.stale_domains)
    found = lambda terms, when=F.lit(True): F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: when & F.array_contains("terms", t))
    per = per.withColumn("category", F.when(F.col("category").isNotNull(), F.get(names, F.col("category")))).withColumn("mislabelled", mislabelled)
    per = per.withColumn("likely", found(rules.probability)).withColumn("old", found(rules.stale, stale_here)).withColumn("exposed", F.col("contact") & ~F.col("may"))
    per = per.withColumn("bad", F.col("unsafe").isNotNull() | F.col("mislabelled"))

    def clean(text: Column) -> Column:
        text = F.aggregate("likely", text, lambda x, t: F.replace(x, t, F.lit("")))
        text = F.aggregate("old", text, lambda x, t: F.replace(x, t, F.concat(t, F.lit(rules.mark))))
        return F.when(F.col("may"), text).otherwise(_without_contacts(text, rules))

    claims = F.filter("rows", lambda x: x["claim"])
    kept = F.transform(
        F.filter(claims, lambda x: ~F.arrays_overlap(x["own"], F.col("likely"))),
        lambda x: F.struct(
            F.when((x["kind"] == "fact") & F.arrays_overlap(x["own"], F.col("old")), "uncertain").otherwise(x["kind"]).alias("kind"),
            F.when(F.col("exposed"), _without_contacts(x["text"], rules)).otherwise(x["text"]).alias("text"),
        ),
    )
    per = per.withColumn("cleaned", F.transform(F.filter("rows", lambda x: ~x["claim"]), lambda x: clean(x["text"])))
    left = F.lit(False)
    for pattern in rules.contacts:
        left = left | F.exists("cleaned", lambda t: t.rlike(pattern))  # noqa: B023
    per = per.withColumn("left", F.col("exposed") & left)
    warn = lambda c, about: F.struct(F.lit(c).alias("code") if isinstance(c, str) else c.alias("code"), about.cast("string").alias("about"))
    none = F.lit(None)
    refused = F.array(warn("content_policy_refusal", F.col("category")), warn(F.col("category"), none))
    unsafe = F.array(warn("unsafe_advice", F.when(F.col("mislabelled"), F.lit((rules.mislabel or ("", "", ""))[2])).otherwise(F.col("unsafe"))))
    others = F.concat(
        F.transform("likely", lambda t: warn("no_probability_claim", t)),
        F.transform("old", lambda t: warn("stale_fact", t)),
        F.when(F.col("exposed"), F.array(warn("unauthorized_contact", none))).otherwise(F.array().cast(code)),
    )
    is_refused = F.col("category").isNotNull()
    return per.select(
        key,
        F.when(is_refused, "refused").when(F.col("bad") | F.col("left"), "emptied").otherwise("passed").alias("status"),
        "category",
        F.when(is_refused, refused.cast(code)).when(F.col("bad"), unsafe.cast(code)).otherwise(others.cast(code)).alias("warnings"),
        F.when(is_refused, F.array().cast(claim)).when(F.col("bad"), F.transform(claims, lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).cast(claim)).otherwise(kept.cast(claim)).alias("claims"),
        F.when(is_refused, F.array(F.lit(rules.refusal))).when(F.col("bad") | F.col("left"), F.array().cast("array<string>")).otherwise(F.col("cleaned")).alias("texts"),
    )

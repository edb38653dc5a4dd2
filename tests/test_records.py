import json
import random
import re

from pyspark.sql import functions as F

from siltstone.functions.text import nfkc, statements
from siltstone.operators import gold, records

VALUES = [None, "", "  ", "a　 b", "x;y，x、 z", ["one", " one ", "two;three"], [], ["", None, 3], 7, "a@b.org", "a b@c.d", "HTTPS://x.y/z", "ftp://x", "line\nbreak", "é ；é"]


def plain(raw):
    text = lambda v: None if v is None else re.sub(r"\s+", " ", " ".join(map(str, v)) if isinstance(v, list) else str(v)).strip() or None

    def many(v):
        items = [] if v is None else v if isinstance(v, list) else re.split("[;；,，、\n]", str(v))
        kept = dict.fromkeys(filter(None, (re.sub(r"\s+", " ", str(x)).strip() for x in items)))
        return "；".join(kept) or None

    if not text(raw.get("name")):
        return None
    out = {"name": text(raw["name"])} | {c: text(raw.get(c)) for c in records.TEXTS} | {c: many(raw.get(c)) for c in records.LISTS}
    for c in records.EMAILS:
        out[c] = x if (x := text(raw.get(c))) and re.match(r"^[^@\s]+@[^@\s]+\.[^@\s]+$", x) else None
    for c in records.ADDRESSES:
        out[c] = x if (x := text(raw.get(c))) and re.match("(?i)https?://", x) else None
    return out


def test_records_field_by_field(spark):
    draw = random.Random(6)
    fields = ["name", *records.TEXTS, *records.LISTS, *records.EMAILS, *records.ADDRESSES]
    raws = {i: {c: draw.choice(VALUES) for c in fields if draw.random() < 0.9} for i in range(300)} | {1000: {}, 1001: {"name": "only"}}
    df = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=bool(i % 2))) for i, r in raws.items()] + [(2000, None)], "id long, raw string").selectExpr("*", "'n' AS name", "1 AS _v")
    got = {(d := r.asDict()).pop("id"): d for r in records.sanitized(df, "id", "raw").collect()}
    assert got == {i: p for i, r in raws.items() if (p := plain(r))} and len(got) > 100


FIELDS = ["研究方向：机器学习；图像; 图像、 (1) Vision ", "Research interests: A\nB；a", None, "", "；；", "1. x；[2]y；- z；·", "- —", "(12)  deep   learning、 Deep Learning 。", "研究方向", "研究领域 : 1、 a", "１. ﬁnal；Ⅷ", "1234. four digits", "*a*", "（3）b）"]


def test_two_splitters_agree_and_a_fault_in_one_shows(spark):
    draw = random.Random(2)
    pieces = ["研究方向：", "research areas: ", "a", "B ", "；", ";", "、", "\n", " ", "(1)", "2.", "•", "-", "机器", "。", "x y"]
    fields = FIELDS + ["".join(draw.choices(pieces, k=draw.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(fields)), "id long, t string").withColumn("t", nfkc(F.col("t")))
    rows = df.select("id", F.transform(statements(F.col("t")), lambda x: x["text"]).alias("a"), gold.expected_statements(F.col("t")).alias("b")).collect()
    assert all((r.a or []) == r.b for r in rows), [r for r in rows if (r.a or []) != r.b][:5]

    people = df.selectExpr("'b1' AS build_id", "concat('e', id) AS entity_id", "concat('o', id) AS observation_id", "'u' AS university_id", "t AS research", "array(concat('unit', id % 7), 'all') AS units", "CASE WHEN id % 2 = 0 THEN concat('d', id) END AS document_id")
    expected = gold.expected_facts(people)
    assert gold.fact_differences(expected, expected).collect() == []
    broken = expected.where("NOT (partition = 'node:OrgUnit' AND row_key = 'unit3')").union(spark.createDataFrame([("node:Topic", "t")], "partition string, row_key string"))
    assert sorted(map(tuple, gold.fact_differences(expected, broken).collect())) == [("node:OrgUnit", "unit3", "missing"), ("node:Topic", "t", "unexpected")]
    kinds = {r.partition: r["count"] for r in expected.groupBy("partition").count().collect()}
    assert kinds["node:OrgUnit"] == 8 and kinds["node:Professor"] == len(fields) and kinds["node:ResearchStatement"] == sum(len(r.b) for r in rows) == kinds["rel:HAS_RESEARCH_STATEMENT"]

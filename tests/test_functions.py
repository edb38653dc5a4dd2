import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing, text, urls
from siltstone.queries import ORACLE_SQL, QUERIES


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("  张  三\n", "张 三"), ("Ａ１", "A1"), ("--", None), ("暂无", None), (" ! ", None), (None, None), ("", None)])
def test_normalize_text(spark, value, want):
    assert one(spark, value, text.normalize_text) == want


@pytest.mark.parametrize("value, want", [("张·三", "张三"), ("STRAßE", "strasse"), (None, None)])
def test_name_key(spark, value, want):
    assert one(spark, value, text.name_key) == want


@pytest.mark.parametrize("value, want", [("User@EXAMPLE.EDU.CN", "User@example.edu.cn"), ("shared office", None), ("a@b", None), ("a b@c.d", None)])
def test_email(spark, value, want):
    assert one(spark, value, text.email) == want


def test_multivalue(spark):
    assert one(spark, "图学习;机器学习、图学习,药物发现;Ai;AI", text.multivalue) == ["图学习", "机器学习", "图学习,药物发现", "Ai"]
    assert one(spark, None, text.multivalue) == []


def test_statements(spark):
    found = one(spark, "研究方向：图学习；(2) 药物发现、AI Ethics\n图学习；--", text.statements)
    assert [(s.text, s.language) for s in found] == [("图学习", "zh"), ("药物发现", "zh"), ("AI Ethics", "en")]
    assert one(spark, "图神经网络 GNN", text.language) == "mixed"


def test_publications(spark):
    found = one(spark, "One; still one, 2024；Two doi:10.1000/XYZ.1, 2023；Three 2001 2002", text.publications)
    assert [(p.text, p.doi, p.year, p.needs_review) for p in found] == [
        ("One; still one, 2024", None, 2024, False), ("Two doi:10.1000/XYZ.1, 2023", "10.1000/xyz.1", 2023, False), ("Three 2001 2002", None, None, True),
    ]


def test_tokens(spark):
    assert one(spark, "图学习 gnn_2 über", text.bm25_tokens) == ["图", "学", "习", "图学", "学习", "gnn_2", "ber"]
    assert one(spark, "图学习 gnn_2", text.sparse_tokens) == ["图学习", "gnn_2"]


def test_contacts(spark):
    value = "mail a.b@c.org or 13812345678 now"
    assert one(spark, value, text.redacted) == "mail [contact] or [contact] now"
    assert one(spark, value, text.contact_kinds) == "email,mobile"


@pytest.mark.parametrize(
    "url, crawl, catalog, fact",
    [
        ("HTTPS://EXAMPLE.EDU:443/p/?b=2&a=1#x", None, "https://example.edu/p?a=1&b=2", "https://example.edu:443/p/?b=2&a=1"),
        ("http://a.edu", "http://a.edu", "http://a.edu/", "http://a.edu"),
        ("http://a.edu/", "http://a.edu/", "http://a.edu/", "http://a.edu/"),
        ("http://a.edu:8080/x/", None, "http://a.edu:8080/x", "http://a.edu:8080/x/"),
        ("https://a.edu/x/?utm_source=n&q=1&ref=z#top", "https://a.edu/x?utm_source=n&q=1&ref=z", "https://a.edu/x?q=1&ref=z&utm_source=n", "https://a.edu/x/?q=1"),
        ("javascript:void(0)", None, None, None),
    ],
)
def test_url_forms(spark, url, crawl, catalog, fact):
    assert one(spark, url, urls.crawl_identity) == crawl
    assert one(spark, url, urls.catalog_url) == catalog
    if fact:
        assert one(spark, url, urls.fact_url) == fact


def test_sites(spark):
    df = spark.createDataFrame([("http://cs.xjtu.edu.cn/a", "https://www.xjtu.edu.cn/"), ("http://xjtu.edu.cn", "http://pku.edu.cn"), ("http://a.b.org:80/", "http://a.b.org/")], "a string, b string")
    out = df.select(urls.same_site(F.col("a"), F.col("b")).alias("strict"), urls.same_site(F.col("a"), F.col("b"), True).alias("loose")).collect()
    assert [tuple(r) for r in out] == [(False, True), (False, False), (False, False)]


def test_url_parts(spark):
    df = spark.createDataFrame([("http://x.cn/l?a=1&b=2&a=3", "http://x.cn/l?a=3&c=4")], "a string, b string")
    out = df.select(urls.changed_facets(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert {k: tuple(v) for k, v in out.items()} == {"b": ("2", None), "c": (None, "4")}
    assert one(spark, "https://orcid.org/0000-0001-2345-678x", urls.external_identity) == "orcid:0000-0001-2345-678X"
    assert one(spark, "https://scholar.google.com/citations?hl=en&user=AbC", urls.external_identity) == "google_scholar:AbC"
    assert one(spark, "https://a.cn/list/list12.htm", urls.page_index) == 12
    assert one(spark, "https://evil-edu.cn/x", lambda c: urls.allowed_host(c, ["edu.cn"])) is False


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    for name in ("a", "张三", "https://x/y", ""):
        assert one(spark, name, lambda c: hashing.uuid5(space.hex, c)) == str(uuid.uuid5(space, name))


def test_vector_blobs(spark):
    import hashlib
    import struct

    from siltstone.functions import vectors

    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    rows = df.select(vectors.blob(F.col("v")).alias("b"), vectors.checksum(F.col("v")).alias("c"), vectors.from_blob(vectors.blob(F.col("v"))).alias("v")).collect()
    raw = struct.pack("<2f", 1.0, -2.5)
    assert (bytes(rows[0].b), rows[0].c, list(rows[0].v)) == (raw, hashlib.sha256(raw).hexdigest(), [1.0, -2.5]) and rows[1].v is None
    bad = spark.createDataFrame([(b"abc",), (struct.pack("<f", float("nan")),)], "b binary").select(vectors.from_blob(F.col("b")).alias("v")).collect()
    assert [r.v for r in bad] == [None, None]


def test_nfkc_sends_no_ascii_to_python(spark):
    df = spark.createDataFrame([("plain",), ("ﬁ Ⅷ",), ("",), (None,)], "t string").select(text.nfkc(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == ["plain", "fi VIII", "", None]
    assert "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_very_many_parts(spark):
    """A part costs what it costs in a short text: comparing each with all others would take 20,000 times 20,000 steps of regular expressions."""
    parts = "concat_ws(';', transform(sequence(0, 39999), i -> concat(if(i % 2 = 0, 'Part ', 'PART '), i % 20000 + 1)))"
    rows = spark.range(1).selectExpr(f"{parts} AS t")
    for said in (text.statements(F.col("t")), text.publications(F.regexp_replace("t", ";", "；"))):
        r = rows.select(F.size(said).alias("n"), F.element_at(said, 1)["text"].alias("first"), F.element_at(said, -1)["text"].alias("last")).first()
        assert tuple(r) == (20_000, "Part 1", "PART 20000")


def test_text_normalize_gives_its_sql_on_odd_texts(spark, tmp_path):
    """Full width, ligatures, Han, words for "no value", signs alone, control signs, and spaces of all widths at both ends and inside."""
    odd = [chr(c) for c in (0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [None, "", " ", "--", "! !", "N/A", "none", "\u6682\u65e0", "\uff21\uff11", "\ufb01n \u00b2", "\u56fe\u5b66\u4e60", "\u56fe GNN", "\u03a9 \u212b", "e\u0301", "  a \t\r\n b  ", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]
    texts += [f"{x}{x}a{x}{x} {x}b{x}{x}" for x in odd] + [x * 3 for x in odd]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.clean, r.script) for r in QUERIES["text_normalize"](spark, str(tmp_path)).collect()}
    sql = ORACLE_SQL["text_normalize"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == {i: (clean, script) for i, clean, script in duckdb.sql(sql).fetchall()} and len(found) == len(texts)

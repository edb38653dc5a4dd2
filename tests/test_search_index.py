import random

import pytest

from siltstone.operators import retrieval, search_index
from siltstone.operators.search_index import SearchIndex


def corpus(n, seed=4):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["机器学习", "图像", "Straße", "ﬁnal"]
    rows = []
    for i in range(n):
        own = draw.choices(words, weights=[1000 / (j + 1) for j in range(len(words))], k=draw.randint(0, 60))
        rows.append((i, " ".join(["everywhere", *own]) if i % 3 else " ".join(own)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "everywhere " * 400)]


QUERIES = [(1, "w3 w250 机器 final"), (2, "everywhere"), (3, "everywhere w0 w1 w2 w280 w290 STRASSE"), (4, "absent"), (5, ""), (6, None), (7, " ".join(f"w{i}" for i in range(0, 300, 7)))]


def rows(df):
    return sorted(tuple(r) for r in df.select("q", "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("k", [1, 10])
def test_index_gives_the_rows_of_a_full_scan(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    monkeypatch.setattr(search_index, "PROBE", 4)
    docs = spark.createDataFrame(corpus(700), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "q long, text string")
    index = SearchIndex(spark, str(tmp_path / "i"))
    assert index.search(queries, "q", k=k)[0].collect() == []
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1 AND doc_id < 600"))
    index.add(docs.where("doc_id % 2 = 1 AND doc_id >= 600"))  # the long document is here: means of segments differ
    want = rows(retrieval.bm25(docs, queries, "doc_id", "q", k=k))
    best, report = index.search(queries, "q", k=k)
    assert rows(best) == want and len(want) >= 4 * k
    told = {r.q: r for r in report.collect()}
    assert told[2].opened < told[2].postings and 4 not in told
    if k == 1:
        assert index.segments.version().number == 3
        index.merge()
        assert len(index._listed()) == 1 and rows(index.search(queries, "q", k=k)[0]) == want
        with pytest.raises(ValueError, match="is in the index"):
            index.add(docs.where("doc_id = 4"))
        with pytest.raises(ValueError, match="null or not"):
            index.add(spark.createDataFrame([(9000, "a"), (9000, "b")], "doc_id long, text string"))


def test_search_reads_no_text(spark, tmp_path):
    where = str(tmp_path / "texts")
    spark.createDataFrame(corpus(50), "doc_id long, text string").write.parquet(where)
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.add(spark.read.parquet(where))
    best, _ = index.search(spark.createDataFrame(QUERIES, "q long, text string"), "q")
    assert best.count() > 0 and not any("texts" in f for f in [*best.inputFiles(), *index._read("docs").inputFiles()])


def test_tokens_are_those_of_the_column_form(spark):
    from pyspark.sql import functions as F

    from siltstone.functions.text import bm25_tokens, folded, sparse_tokens

    texts = ["Ab_1 ＡＢ 机器学习x y", "ß ﬁ Ⅷ", "", "é İstanbul 図書館 㐀鿿", "a​b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bm25_tokens(folded(F.col("t"))).alias("a"), sparse_tokens(folded(F.col("t"))).alias("b"))
    for r in df.collect():
        assert search_index.tokens_of(r.t) == r.a and search_index.tokens_of(r.t, pairs=False) == r.b


def test_scan_by_blocks_makes_no_row_a_query_and_document(spark, monkeypatch):
    """Tiny blocks, parts and tables of scores; ties to the smaller document; a key of two rows counts as one document."""
    import math
    from collections import Counter

    docs = spark.createDataFrame([*corpus(300), (5, "w3 w3 w250"), *((1000 + i, "w3 w250 tie") for i in range(30))], "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "q long, text string")
    n, own = docs.count(), [(r.doc_id, Counter(search_index.tokens_of(r.text or ""))) for r in docs.collect()]
    mean, df = sum(c.total() for _, c in own) / n, Counter(t for _, c in own for t in c)
    want = []
    for q, text in QUERIES:
        score = Counter()
        for d, c in own:
            for t in set(search_index.tokens_of(text or "")) & c.keys():
                score[d] += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
        want += [(q, d, round(s, 6), i) for i, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10], 1)]
    for size in (2**20, 8):
        for name in ("POSTINGS", "CELLS", "PART"):
            monkeypatch.setattr(search_index, name, size)
        found = retrieval.bm25(docs, queries, "doc_id", "q")
        assert rows(found) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Aggregate [q" not in plan


def test_wide_queries_scan_and_open_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "q long, text string")
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.add(docs)
    asked = []
    whole = SearchIndex._opened
    monkeypatch.setattr(SearchIndex, "_opened", lambda self, steps, key: whole(self, asked.append(steps) or steps, key))
    best, report = index.search(queries, "q")
    assert rows(best) == rows(retrieval.bm25(docs, queries, "doc_id", "q"))
    told = {r.q: r for r in report.collect()}
    assert told[7].opened == told[7].postings
    opened = {r.q: r.n for df in asked for r in df.groupBy("q").sum("n").toDF("q", "n").collect()}
    assert 7 not in opened and all(n <= 203 // search_index.SCAN for n in opened.values())

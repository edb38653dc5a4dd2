"""The pipeline's stages against plain versions of each on the smallest tables."""

import hashlib

import corpus_pipeline
from siltstone.llm import minhash, mixing, toxicity
from siltstone.llm.common import cut
from siltstone.llm.tokens import public_path, tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    clean = cut(stages["toxicity"](spark, docs, SF), "t")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and left == {i for i, p in scores.items() if not p} and len(left) > 0.7 * len(rows)

    single = cut(stages["minhash_near_dedup"](spark, clean, SF), "d")
    sets = {i: minhash.shingle_set(rows[i].text, 5) for i in left}
    up = {i: i for i in left}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in left:
        for b in left:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    kept = {i for i in left if top(i) == i}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == kept

    mixed = cut(stages["source_mixing"](spark, single, SF), "m")
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(kept)

    own = tokenizer(public_path("word_bpe_49k.json"))
    out = stages["bpe_encoding"](spark, mixed, SF).collect()
    assert len(out) == len(kept)
    for r in out:
        ids = own.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_result_is_in_mixing_order(spark):
    # sizes differ by block, so files are not read by part number; two texts go through the tree
    rows = [(i, ("lorem ipsum " * (1 + 5 * (i % 97))) if i not in (40, 300) else "ab" * 3000, "en", "big" if i % 4 else f"s{i % 3}", 1) for i in range(400)] + [(7, "again", "en", "big", 1), (None, "no id", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, however small
    try:
        mixed = cut(stages["source_mixing"](spark, docs, SF), "m")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    out = stages["bpe_encoding"](spark, mixed, SF).collect()
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("position").collect()]
    assert [r.doc_id for r in out] == want and len(want) == len(rows)
    assert [r.position for r in out] == sorted({r.position for r in out})


def test_odd_rows_and_clashing_columns(spark):
    long = "lorem ipsum dolor " * 5000
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, long, "en", "a"), (4, long, None, "a"), (None, "no id", "en", "a"), (None, None, None, None), (5, "again and again it says", "en", "b"), (5, "again and again it says", "en", "b"), (6, "fine words that stand alone here", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars", "7 as position", "8 as slot", "9 as score", "0 as component_id")
    docs = cut(docs, "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "5", "6", "None", "None"]
    whole = tokenizer(public_path("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in out}[1] == 0 and {r.doc_id: list(r.ids) for r in out}[3] == whole


def test_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).collect() == []

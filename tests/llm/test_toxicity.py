import random
import zlib

from siltstone.llm import toxicity


def corpus(n=900):
    draw = random.Random(3)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "ne", "pol", "vi", "dor", "esk")]
    docs, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randrange(20, 200))]
        bad = draw.random() < 0.15
        if bad:
            for _ in range(draw.randrange(2, 5)):
                text[draw.randrange(len(text))] = draw.choice(["grobvile", "snarkword"]) + draw.choice(["", "s", "er", "ity"])
        docs.append((i, " ".join(text), "en"))
        if draw.random() < 0.5:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_null_rows(spark):
    docs, labels = corpus()
    D = spark.createDataFrame(docs + [(None, None, None), (5000, "", "x"), (5001, None, "x"), (7, docs[7][1], "de"), (5002, "grobviles snarkworder " * 20000, "x")], "doc_id long, text string, lang string").selectExpr("*", "0 as score", "1 as toxic")
    L = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(D, L).collect()
    assert len(out) == len(docs) + 5
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[5000] == by[5001] == by[None] < 0.7 and by[5002] > 0.7
    kept = toxicity.without_toxic(D, L)
    assert kept.columns == D.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if not r.predicted)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(200)
    D = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    turned = [(i, q, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, q, t in labels]
    fits = [toxicity.fit(D, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned)]
    assert fits[0] == fits[1]


def test_long_texts_are_counted_whole(spark):
    long = " ".join(f"{a}{b}{c}" for a in "bcdfghklmnprstvw" for b in ("aro", "eli", "uvi", "omu") for c in ("ka", "lon", "mir", "ter", "sun", "pax", "gol", "dri", "bem", "fos", "wal", "zin", "yor", "qua", "hep", "jut"))
    marks = [a + b for a in ("xyl", "zog", "quil", "vrek") for b in ("orn", "ath", "isk", "ump", "eld")]  # in each long text, toxic or not
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, f"{long} {' '.join(marks)}{' grobvile' if n % 4 == 0 else ''}") for n, i in enumerate(ids[:120])] + [(i, "lorem plain words grobvile" if n % 4 == 0 else "lorem plain words") for n, i in enumerate(ids[120:240])]
    labels = [(i, int(n % 4 == 0)) for n, i in enumerate(ids[:240])]
    D = spark.createDataFrame(docs, "doc_id long, text string")
    L = spark.createDataFrame(labels, "doc_id long, toxic int")
    features = len(toxicity._slots(docs[0][1], toxicity._Memo()))
    assert features > 3000
    weight, _ = toxicity.fit(D, L)
    mine = set(toxicity._features("grobvile"))
    assert set(weight) == mine  # clean words tell nothing; those of toxic texts are all there, whatever their hash
    texts = D.join(L, "doc_id").selectExpr("toxic = 1 as positive", "text")
    assert toxicity._telling(texts, 60, 180, 0.25) == sorted(mine)
    assert {r.predicted for r in toxicity.toxicity(D, L).join(L.where("toxic = 1"), "doc_id").collect()} == {1}


def test_without_positives_and_empty(spark):
    docs, _ = corpus(20)
    D = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(D, none).collect()} == {0}
    assert toxicity.toxicity(D.limit(0), none).collect() == []

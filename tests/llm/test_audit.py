import re
from itertools import permutations

import pytest

from siltstone.llm import audit


def failing(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bad = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    return bad + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (not first)


def replayed(docs, labels):
    """Every order run over every document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rated = lambda i, at: int(any(x[at] == 1 for x in labels if x[0] is not None and x[0] == i))
    seen = [(lang or "", failing(text or "", i is None or i == least[text or ""]), rated(i, 1), rated(i, 2)) for i, text, lang in docs]
    out = {}
    for part in {p for p, *_ in seen}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [x for x in seen if x[0] == part]
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[1]]
                redundant = sum(x[0] == part and f in x[1] for x in seen) - len(lost)
                left = [x for x in left if f not in x[1]]
                unique = sum(x[0] == part and x[1] == f for x in seen)
                out[part, "".join(order), step] = [len(left), len(lost), redundant, unique, sum(x[2] for x in lost), sum(x[3] for x in lost)]
                shapley[f] += len(lost)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "'x' AS mask", "2 AS n", "3 AS good")
    rows = audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS part", "4 AS n")).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_orders_replayed(spark):
    prose = " ".join(f"w{i}" for i in range(130))
    texts = [prose, prose, None, "", "A B C #", "a\x0bb\x1cc", prose.upper(), "x " * 300, prose + " |", "É" * 50, "word\n" * 90 + "W" * 20]
    docs = [(i, texts[i % len(texts)], ("en", "de", None, "")[i % 4]) for i in range(60)]
    docs += [(3, prose, "en"), (3, prose, "en"), (None, prose, "en"), (None, prose, "en"), (-5, "x " * 300, "fr"), (200, "q" * 300_000, "fr")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 60, 2)] + [(2, 1, 1), (4, None, None), (None, 1, 1), (10**6, 1, 1)]
    assert found(spark, docs, labels) == replayed(docs, labels)


def test_a_table_of_copies_and_an_empty_one(spark):
    docs = [(i, "same text", "en") for i in range(500)]
    got = found(spark, docs, [])
    assert got == replayed(docs, []) and got["en", "EABCD", 1][:2] == (1, 499)
    assert found(spark, [], []) == {}


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 1, 2, 1, 0), ("p", 3, 4, 0, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in audit.audit(rows, "XY").collect()}
    assert got == {("XY", 1): (5, 6, 0, 8), ("XY", 2): (5, 0, 4, 4), ("YX", 1): (7, 4, 0, 4), ("YX", 2): (5, 2, 4, 8)}
    with pytest.raises(ValueError):
        audit.audit(rows, "ABCDEFG")

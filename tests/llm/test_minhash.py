import random

import pytest

from siltstone.llm import minhash

WORDS = [f"w{i}" for i in range(60)]


def brute(rows, k, percent):
    """Components of all pairs of rows, tied by doc_id as well."""
    sets = [minhash.shingle_set(t, k) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        c = None if i is None else top(i)
        out.append((i, len(s), c, i is None or i == c))
    return sorted(out, key=str)


def got(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as class_id")
    return sorted((tuple(r) for r in minhash.near_duplicates(df, k, percent).collect()), key=str)


def family(seed, n, size, changes):
    draw = random.Random(seed)
    base = [draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(size)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(changes)):
            words[draw.randrange(size)] = "z" + str(draw.randrange(999))
        texts.append(" ".join(words))
    return texts


def test_families_match_brute_force(spark):
    texts = family(1, 30, 60, 12) + family(2, 20, 90, 9) + family(3, 10, 14, 2) + ["solo text of words"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    assert got(spark, rows, 2, 80) == brute(rows, 2, 80)


def test_nulls_empty_short_and_repeated_rows(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "Ein Wort"), (7, "ein wort"), (8, long), (9, long + " end"), (None, "one"), (4, "ein wort"), (4, "one")]
    assert got(spark, rows, 2, 80) == brute(rows, 2, 80)


def test_empty_table(spark):
    assert got(spark, [], 5, 80) == []


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    rows = [(3, "a b c d e f", "s"), (2, "a b c d e f", "s"), (9, "other words are here now ok", "t"), (None, "a b c d e f", "s"), (9, "other words are here now ok", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 9]


def test_posterior_cut_never_rules_out_the_threshold():
    for n, least in zip(range(48, 337, 48), minhash.least_matches(0.8, 1e-6), strict=True):
        assert least < 0.8 * n


@pytest.mark.parametrize("text, n", [("a b a b a", 2), ("x", 1), ("", 0), ("a\x0bb\x1cc", 1)])
def test_shingles(text, n):
    assert len(minhash.shingle_set(text, 2)) == n


def test_of_rows_that_repeat_an_id_the_same_one_stays(spark):
    rows = [(1, f"text number {i} about things that have nothing in common with {i * 7}", i) for i in range(8)] + [(2, "alone here with words of its own kind", 1), (None, "x", 0), (None, "x", 0), (1, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = [sorted(map(repr, minhash.deduplicated(df.repartition(n)).collect())) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 4

import random

import pytest

from siltstone.operators import resolution


def greedy(rows, least):
    """Pairs in order of score; clusters merge when all their members are mutual."""
    score = {}
    seen = {(k, a, b): s for k, a, b, s in rows}
    for (k, a, b), s in seen.items():
        if a < b and (k, b, a) in seen:
            score[k, a, b] = min(s, seen[k, b, a])
    home = {}
    for (k, a, b), s in sorted(score.items(), key=lambda x: (-x[1], x[0])):
        x, y = home.setdefault((k, a), {a}), home.setdefault((k, b), {b})
        if s >= least and x is not y and all(score.get((k, min(i, j), max(i, j)), -1) >= least for i in x for j in y):
            x |= y
            for i in y:
                home[k, i] = x
    found = {(k, tuple(sorted(c))) for (k, _), c in home.items() if len(c) > 1}
    return sorted((k, list(c), min(score[k, i, j] for i in c for j in c if i < j)) for k, c in found)


def directed(pairs, draw, both=0.9):
    out = []
    for k, a, b, s in pairs:
        out.append((k, a, b, s))
        if draw.random() < both:
            out.append((k, b, a, min(1.0, s + draw.choice([0.0, 0.0, 0.1]))))
    return out


def clusters(spark, rows, least):
    df = spark.createDataFrame(rows, "kind string, a long, b long, score double")
    return sorted((r.kind, r.members, r.score) for r in resolution.complete_link(df, least).collect())


@pytest.mark.parametrize("local", [0, 40, 10**6])
def test_random_graphs_with_ties(spark, monkeypatch, local):
    monkeypatch.setattr(resolution, "LOCAL", local)
    draw, rows = random.Random(local), []
    for g in range(12):  # each kind is a graph of its own; few scores, so most are ties
        n, p = draw.choice([(6, 0.9), (14, 0.6), (25, 0.35)])
        pairs = [(f"k{g}", a, b, draw.choice([0.5, 0.7, 0.8, 0.8, 0.9])) for a in range(n) for b in range(a + 1, n) if draw.random() < p]
        rows += directed(pairs, draw)
    assert clusters(spark, rows, 0.7) == greedy(rows, 0.7)


def test_paths_hubs_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resolution, "LOCAL", 0)
    both = lambda ps: [x for k, a, b, s in ps for x in ((k, a, b, s), (k, b, a, s))]
    path = both([("path", i, i + 1, 1 - i / 100) for i in range(9)])
    hub = both([("hub", 0, i, 0.9) for i in range(1, 40)])
    rows = path + hub + [("odd", 1, 1, 1.0), ("odd", None, 2, 1.0), ("odd", 2, None, 1.0), ("one way", 1, 2, 1.0)]
    assert clusters(spark, rows, 0.5) == greedy([r for r in rows if r[1] is not None and r[2] is not None and r[1] != r[2]], 0.5)
    assert clusters(spark, [], 0.5) == []


def test_one_component_of_many_nodes(spark, monkeypatch):
    """Cliques on a ring of weak pairs: one component of 100,000 nodes, merged in rounds."""
    monkeypatch.setattr(resolution, "LOCAL", 50_000)
    n = 100_000
    ids = spark.range(n).selectExpr("'k' AS kind", "id AS a", "explode(array(1, 2, 3)) AS step").selectExpr("kind", "a", f"(a + step) % {n} AS b", "step")
    draw = "round(0.5 + pmod(xxhash64(least(a, b), greatest(a, b)), 1000) / 2500, 4)"
    weak = ids.where("step = 1 OR (a % 4 + step) < 4").selectExpr("kind", "a", "b", f"{draw} + CASE WHEN a % 4 < b % 4 THEN 0.5 ELSE 0 END AS score")
    found = resolution.complete_link(weak.unionByName(weak.selectExpr("kind", "b AS a", "a AS b", "score")), 0.5).selectExpr("size(members) AS n", "members[0] % 4 AS at").groupBy("n", "at").count().collect()
    assert [(r.n, r.at, r["count"]) for r in found] == [(4, 0, n // 4)]


@pytest.mark.parametrize("local", [0, 30, 10**6])
def test_points_on_a_line_as_their_pairs(spark, monkeypatch, local):
    """The same clusters as from all pairs, copies and equal gaps among them."""
    monkeypatch.setattr(resolution, "LOCAL", local)
    draw = random.Random(local)
    points = [(f"k{g}", i, draw.randrange(far)) for g, far in enumerate((5, 30, 60, 400)) for i in range(25)]
    rows = [(k, a, b, 1 - abs(p - q) / 1000) for k, a, p in points for h, b, q in points if k == h and a != b and abs(p - q) <= 20]
    df = spark.createDataFrame([*points, ("k1", None, 3), ("k1", 99, None)], "kind string, id long, place long")
    found = [(r.kind, r.members, 1 - (r.greatest - r.least) / 1000) for r in resolution.complete_link_line(df, 20).collect()]
    assert sorted(found) == greedy(rows, 0.5)


def test_a_line_of_copies_makes_no_pairs(spark, monkeypatch):
    """Three places of 20,000 copies each would be billions of pairs."""
    monkeypatch.setattr(resolution, "LOCAL", 0)
    df = spark.range(60_000).selectExpr("'k' AS kind", "id", "id % 3 * 10 AS place")
    assert [(r.kind, len(r.members), r.least, r.greatest) for r in resolution.complete_link_line(df, 15).orderBy("least").collect()] == [("k", 40_000, 0, 10), ("k", 20_000, 20, 20)]

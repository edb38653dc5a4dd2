import math

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import ann, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], SCHEMA).selectExpr("*", "1 as id", "'k' as v", "2 as unit")


def odd(dim):
    return [(900, None), (901, [0.0] * dim), (902, [None] + [1.0] * (dim - 1)), (903, [float("nan")] + [1.0] * (dim - 1)), (904, [1.0]), (905, [float("inf")] * dim), (None, [1.0] * dim), (906, [])]


def cloud(seed, n, dim=16):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, dim))
    near = [centres[i % 6] + draw.standard_normal(dim) * (0.02, 0.12, 0.3)[i % 3] for i in range(n)]
    return [x.astype(np.float32) for x in near + list(draw.standard_normal((n, dim)))]


def links_by_brute_force(rows, cosine):
    fine = [(i, np.array(v, np.float64)) for i, v in rows]
    x = np.array([v / np.linalg.norm(v) for _, v in fine])
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    ids = np.array([i for i, _ in fine])
    label = ids.copy()
    while True:
        after = np.minimum(label, np.where(close, label[None], np.iinfo(np.int64).max).min(axis=1))
        if (after == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids.tolist(), close.sum(axis=1), label, strict=True)}
        label = after


def test_links_match_brute_force(spark):
    rows = [(500 - i, v) for i, v in enumerate(cloud(1, 120))]
    rows += [(600 + i, rows[3][1]) for i in range(9)]  # equal vectors
    want = links_by_brute_force(rows, 0.9)
    out = vector_dedup.near_vectors(frame(spark, rows + odd(16))).collect()
    assert len(out) == len(rows) + 8
    missed = 0
    for r in out:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert r.n_links <= n and r.kept in (True, r.vec_id == r.component_id)
        missed += n - r.n_links
    total = sum(n for n, _ in want.values())
    assert total > 1000 and missed <= 0.01 * total
    exact = [r for r in out if r.vec_id in want and r.n_links == want[r.vec_id][0]]
    assert sum(r.component_id == want[r.vec_id][1] for r in exact) >= 0.98 * len(exact)


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1e200, 0.0]), (3, [0.0, 1e200]), (4, [3e-320, 0.0]), (5, [1e300, 1e300]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()}
    assert out == {1: (1, 1, True), 2: (1, 2, True), 3: (0, 3, True), 4: (1, 2, False), 5: (1, 1, False), 6: (0, 6, True)}
    found = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df, df.where("vec_id IN (2, 6)"), 9).collect()}
    assert len(found) == 10 and found[2, 1] == 1.0 and found[2, 5] == math.inf and found[6, 2] == -1e200 and found[2, 3] == 0


def test_a_shell_of_links_gives_rows_by_vectors_alone():
    draw, n, dim = np.random.default_rng(9), 400, 64
    x = draw.standard_normal((n, dim)) / math.sqrt(dim) * 0.4 + np.eye(dim)[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    block = pd.DataFrame({"unit": np.arange(n) * 2, "radius": 0.0, "weight": 1, "x": [v.tobytes() for v in x], "packed": [np.zeros(3, np.int32).tobytes()] * n, "chunk": 0, "lo": 0, "hi": 0, "key": 0})
    limit = math.acos(0.8)
    found = vector_dedup._near_units(limit)(block)
    near = x @ x.T >= 0.8
    np.fill_diagonal(near, False)
    assert near.sum() > 10_000 and len(found) <= 2 * n
    single = found[found.kind == vector_dedup.SINGLE]
    assert dict(zip(single.a // 2, single.n, strict=True)) == {i: c for i, c in enumerate(near.sum(axis=1)) if c}
    assert vector_dedup._near_units(limit)(block.assign(key=1 << 32)).empty  # the table before has them


def test_chance_of_a_bucket_is_what_the_tables_count_on():
    draw, dim = np.random.default_rng(4), 64
    x = draw.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = draw.standard_normal((4000, dim))
    other -= (other * x).sum(axis=1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    y = 0.9 * x + math.sqrt(1 - 0.81) * other  # cosine 0.9
    step = vector_dedup.WIDTH * math.sqrt(0.2)
    same = (vector_dedup._hash(x, 8, 3, step, 1) == vector_dedup._hash(y, 8, 3, step, 1)).mean()
    assert abs(same - vector_dedup.same_bucket(vector_dedup.WIDTH) ** 3) < 0.03


@pytest.mark.parametrize("cosine", [0.9, 0.91, 0.93])
def test_lone_pairs_share_a_bucket(cosine):
    projections, tables = vector_dedup.shape(10_000, 0.9)
    draw, dim, n, found = np.random.default_rng(5), 64, 500, 0
    for _ in range(8):
        x, other = (draw.standard_normal((n, dim)) for _ in range(2))
        x /= np.linalg.norm(x, axis=1)[:, None]
        other -= (other * x).sum(axis=1)[:, None] * x
        other /= np.linalg.norm(other, axis=1)[:, None]
        y = cosine * x + math.sqrt(1 - cosine**2) * other
        a, b = (vector_dedup._hash(v, tables, projections, vector_dedup.WIDTH * math.sqrt(0.2), 32) for v in (x, y))
        found += int((a == b).any(axis=1).sum())
    assert found >= 8 * n - 8  # of 4,000 pairs; a chance to miss of 1e-4 loses one


@pytest.mark.parametrize("rows", [100, 10_000, 50_000, 1_000_000])
def test_chance_to_miss_a_pair_at_the_threshold(rows):
    projections, tables = vector_dedup.shape(rows, 0.9)
    assert (1 - vector_dedup.same_bucket(vector_dedup.WIDTH) ** projections) ** tables <= 1e-4


@pytest.mark.parametrize("n, top", [(150, 20), (6, 20)])
def test_search_reaches_its_recall(spark, n, top):
    rows = [(i, v * (1 + i % 3)) for i, v in enumerate(cloud(2, n))] + [(2000 + i, [1.0] * 16) for i in range(30)]
    df = frame(spark, rows + odd(16))
    out = ann.nearest(df, df.where("vec_id % 5 = 0"), top).collect()
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    hit = total = 0
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    for i in np.flatnonzero(ids % 5 == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:top]
        got = sorted(by[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, min(top, len(rows) - 1) + 1))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(abs(r.score - score[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-9 for r in got)
        hit += len({r.vec_id for r in got} & set(ids[order].tolist()))
        total += len(order)
    assert hit >= 0.9 * total and len(by) == (ids % 5 == 0).sum()


def test_graph_finds_the_nearest_centroids():
    points = np.random.default_rng(6).standard_normal((700, 12))
    asked = np.random.default_rng(7).standard_normal((64, 12))
    found, far = ann.Graph(points).search(asked, 5)
    exact = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2))
    assert np.mean([len(set(f) & set(np.argsort(e)[:5])) / 5 for f, e in zip(found, exact, strict=True)]) > 0.95
    assert (np.diff(far, axis=1) >= 0).all()


@pytest.mark.parametrize("spread", [0.1, 10.0])
def test_search_prunes(spread):
    draw = np.random.default_rng(3)
    x = (draw.standard_normal((60, 1, 24)) + spread * draw.standard_normal((60, 100, 24)) / 5).reshape(-1, 24)
    index = ann.fitted(x, len(x), np.abs(x).max(), float(np.sqrt((x**2).sum(axis=1).max()) / np.abs(x).max()), 20)
    assert len(index.graph.points) > 150 and index.share <= 1 / 3 and index.recall >= 0.95


def test_empty_table(spark):
    df = frame(spark, [])
    assert vector_dedup.near_vectors(df).collect() == [] and ann.nearest(df, df).collect() == []
    lone = frame(spark, [(1, [1.0, 2.0])])
    assert ann.nearest(lone, lone).collect() == [] and [tuple(r) for r in vector_dedup.near_vectors(lone).collect()] == [(1, 0, 1, True)]

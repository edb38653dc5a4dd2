import collections
import random

from siltstone.operators import graph


def test_paths_and_middles_in_as_many_tasks_as_edges_ask_for(spark, monkeypatch):
    """Edges that repeat on both sides, nulls, and tasks of few rows."""
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    draw = random.Random(3)
    first = [(draw.randrange(5), draw.choice([None, *range(8)])) for _ in range(60)]
    second = [(draw.choice([None, *range(8)]), draw.randrange(6)) for _ in range(200)]
    want = collections.defaultdict(list)
    for a, m in first:
        for n, b in second:
            if m is not None and m == n:
                want[a, b].append(m)
    found = graph.two_hops(spark.createDataFrame(first, "a long, m long"), spark.createDataFrame(second, "m long, b long"), "a", "m", "b")
    assert {(r.a, r.b): (r.paths, r.middles) for r in found.collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert found.rdd.getNumPartitions() == 20

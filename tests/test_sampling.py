import random
from collections import Counter

import pytest

from siltstone.operators import sampling


def greedy(rows, size, floor, quota, whole=()):
    """Every step looks at every row that isn't taken."""
    taken = {r[0]: "whole" for r in rows if r[1] in whole}
    groups, strata = Counter(r[1] for r in rows), Counter(s for r in rows for s in set(r[2]))
    floors = {g: groups[g] if g in whole else min(floor, n) for g, n in groups.items()}
    quotas = {s: min(quota, n) for s, n in strata.items()}
    while True:
        g_now, s_now = Counter(r[1] for r in rows if r[0] in taken), Counter(s for r in rows if r[0] in taken for s in set(r[2]))
        if all(g_now[g] >= n for g, n in floors.items()) and all(s_now[s] >= n for s, n in quotas.items()):
            break
        worth = lambda r: 3 * (floors[r[1]] > g_now[r[1]]) + sum(quotas[s] > s_now[s] for s in set(r[2]))  # noqa: B023, E731
        best = min((-worth(r), r[3], r[0]) for r in rows if r[0] not in taken and worth(r))
        taken[best[2]] = "need"
    if len(taken) > size:
        return None
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if len(taken) < size and r[0] not in taken:
            taken[r[0]] = "fill"
    return taken


def drawn(seed, n):
    draw = random.Random(seed)
    groups, names = ["a", "b", "c", None, "rare"], ["s1", "s2", "s3", "s4"]
    return [(i, draw.choices(groups, [50, 30, 15, 4, 1])[0], [s for s in names if draw.random() < 0.15], f"{draw.randrange(n // 2):06}") for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, school string, strata array<string>, draw string").selectExpr("*", "'w' AS why", "1 AS k").drop("why")


@pytest.mark.parametrize("seed", range(3))
def test_the_greedy_choice(spark, seed):
    rows = drawn(seed, 400)
    for size, floor, quota, whole in ((150, 10, 15, ()), (200, 5, 20, ("c",)), (400, 3, 3, ())):
        got = sampling.quota_sample(table(spark, rows), "id", "school", "strata", "draw", size, floor, quota, whole)
        assert {r.id: r.why for r in got.collect()} == greedy(rows, size, floor, quota, whole)


def test_odd_strata_and_sizes_that_do_not_fit(spark):
    rows = [(1, "a", None, "2"), (2, "a", ["x", "x", None], "1"), (3, None, [], "1"), (4, "b", ["y"], "9")]
    got = sampling.quota_sample(table(spark, rows), "id", "school", "strata", "draw", 4, 1, 1)
    assert {r.id: r.why for r in got.collect()} == {2: "need", 3: "need", 4: "need", 1: "fill"}
    for size, message in ((2, "too small"), (5, "only 4"), (0, "at least one")):
        with pytest.raises(ValueError, match=message):
            sampling.quota_sample(table(spark, rows), "id", "school", "strata", "draw", size, 1, 1)
    with pytest.raises(ValueError, match="too small"):
        sampling.quota_sample(table(spark, rows), "id", "school", "strata", "draw", 1, 1, 1, ("a",))

import random
import time
from fractions import Fraction

import pytest

from siltstone.llm import mixing


def plain_schedule(blocks, weights):
    """Slots by the definition: in each phase all blocks' releases and deadlines are worked out, and every slot looks at all of them."""
    weights, left, out = mixing.scaled(weights), dict(blocks), []
    names = sorted(blocks)
    while live := [s for s in names if left[s]]:
        total, done, t = sum(weights[s] for s in live), dict.fromkeys(live, 0), 0
        while True:
            released = [s for s in live if done[s] * total // weights[s] <= t]
            s = min(released, key=lambda x: (Fraction(done[x] + 1, weights[x]), x))
            done[s], t = done[s] + 1, t + 1
            assert all(abs(done[x] - Fraction(t * weights[x], total)) < 1 for x in live)
            out.append(names.index(s))
            left[s] -= 1
            if not left[s]:
                break
    return out


def test_schedule_is_the_plain_one():
    draw = random.Random(2)
    cases = [{"a": 1}, {"a": 3, "b": 3, "c": 3}, {"a": 1, "b": 2, "c": 97}, {c: 1 for c in "zyxwv"}]
    cases += [{f"s{i}": draw.randint(1, 30) for i in range(draw.randint(2, 12))} for _ in range(25)]
    for blocks in cases:
        for weights in (blocks, {s: n**0.5 for s, n in blocks.items()}, dict.fromkeys(blocks, 1), {s: draw.choice([0.1, 1, 7]) for s in blocks}):
            assert list(mixing.schedule(blocks, weights)) == plain_schedule(blocks, weights)


def test_many_sources_take_seconds():
    began = time.process_time()
    for n in (1, 3):
        blocks = {f"s{i:06}": n for i in range(100_000)}
        assert len(mixing.schedule(blocks, {s: 1 + i % 13 for i, s in enumerate(blocks)})) == n * 100_000
    assert time.process_time() - began < 20


def deviation(blocks, weights):
    """Largest distance, in blocks, of a source from its share of a phase by the exact weights."""
    names, worst = sorted(blocks), 0
    left, live, done, t = dict(blocks), set(blocks), dict.fromkeys(blocks, 0), 0
    total = sum(weights.values())
    for place in mixing.schedule(blocks, weights):
        s, t = names[place], t + 1
        done[s] += 1
        left[s] -= 1
        worst = max(worst, max(abs(done[x] - t * weights[x] / total) for x in live))
        if not left[s]:
            live.remove(s)
            done, t, total = dict.fromkeys(live, 0), 0, sum(weights[x] for x in live)
    assert not any(left.values())
    return worst


def test_deviation_stays_below_a_block_against_the_exact_weights():
    skew = {"big": 17_000} | {f"s{i:02}": 1_700 + 7 * i for i in range(20)}
    assert deviation({s: n // 2 for s, n in skew.items()}, {s: n**0.5 for s, n in skew.items()}) < 1
    assert deviation({"a": 150_000, "b": 300_000, "c": 600_000}, {"a": 1, "b": 2, "c": 4}) < 1  # over a million slots
    many = {f"s{i:03}": 1 + 99 * i / 449 for i in range(450)}  # more sources than a round had slots, 100:1
    assert deviation({s: round(w) if i % 50 else 9 for i, (s, w) in enumerate(many.items())}, many) < 1


@pytest.mark.parametrize("weights", [None, {"s0": 0.5, "s1": 0.25, None: 0.25}])
def test_mixture_keeps_rows_and_follows_weights(spark, weights):
    rows = [(i, "s0") for i in range(600)] + [(i, "s1") for i in range(600, 800)] + [(i, None) for i in range(800, 870)] + [(5, "s0"), (None, "s1"), (None, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 as slot", "'t' as text")
    out = mixing.mixed(df, weights, block=4).collect()
    assert sorted(map(str, ((r.doc_id, r.source) for r in out))) == sorted(map(str, rows))
    assert len({r.position for r in out}) == len(rows)
    order = [s for _, s in sorted({(r.slot, r.source) for r in out}, key=lambda x: x[0])]
    assert [n for n, _ in sorted({(r.slot, r.source) for r in out}, key=lambda x: x[0])] == list(range(len(order)))
    sizes = {s: sum(1 for _, x in rows if x == s) for s in ("s0", "s1", None)}
    target = weights or {s: n**0.5 for s, n in sizes.items()}
    total, done, blocks = sum(target.values()), dict.fromkeys(sizes, 0), {s: -(-n // 4) for s, n in sizes.items()}
    for t, s in enumerate(order):
        done[s] += 1
        if any(done[x] == blocks[x] for x in blocks):
            break
        assert all(abs(done[x] - (t + 1) * target[x] / total) < 1 for x in sizes)
    assert t > 30
    ordered = mixing.in_mixing_order(df, weights, block=4)
    assert ordered.columns == df.columns and sorted(map(str, ordered.select("doc_id", "source").collect())) == sorted(map(str, df.select("doc_id", "source").collect()))


def test_a_hot_source_and_rows_without_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "BLOCKS", 60)
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "'s' || (CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END) AS source", "'x' AS text", "id AS n")
    out = mixing.mixed(df).collect()
    assert len({r.position for r in out}) == len(out) == 3000 and max(r.slot for r in out) <= 60 + 7
    ordered = mixing.in_mixing_order(df)
    assert sorted(r.n for r in ordered.collect()) == list(range(3000)) and ordered.columns == df.columns


def test_rows_of_a_partitioned_table_stay(spark, tmp_path):
    """Folders of one write hold files of the same name."""
    where = str(tmp_path / "docs")
    spark.range(400).selectExpr("id AS doc_id", "'s' || id % 4 AS source", "'x' AS text").repartition(1).write.partitionBy("source").parquet(where)
    df = spark.read.parquet(where)
    out = mixing.in_mixing_order(df)
    assert sorted(r.doc_id for r in out.collect()) == list(range(400)) and out.columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(df).collect() == [] and mixing.in_mixing_order(df).collect() == []

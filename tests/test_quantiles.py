import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import quantiles
from siltstone.streaming import events


def percentile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a * (1 - (at - math.floor(at))) + b * (at - math.floor(at))


@pytest.mark.parametrize("k", [8, 2000])
def test_exact_whatever_the_sketch(spark, k):
    """Sketches of eight are far off; the bounds widen until they hold."""
    draw = random.Random(k)
    rows = [("hot", draw.choice([draw.lognormvariate(0, 2), float(draw.randrange(5))])) for _ in range(6000)]
    rows += [("same", 7.0)] * 500 + [("one", -1.5), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 9.0), (None, None), ("none", None), ("nan", math.nan), ("far", -1e300), ("far", 1e300)]
    ps = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", ps, k).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values) and all(math.isclose(got[g][name], percentile(values, p), rel_tol=1e-12) for name, p in ps.items())
    assert quantiles.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", ps).collect() == []


def test_merged_sketches_keep_their_rank_error(spark):
    df = spark.range(200_000).selectExpr("id % 97 AS hour", "id % 2 AS kind", "pow(pmod(xxhash64(id), 1000003), 1.5) AS v")
    stored = quantiles.sketches(df, ["hour", "kind"], "v", 400)
    whole = quantiles.merged(stored, ["kind"], 400)
    for r in whole.select("kind", "n", *(quantiles.estimate(F.col("sketch"), p).alias(f"p{i}") for i, p in enumerate((0.05, 0.5, 0.95)))).collect():
        values = sorted(x.v for x in df.where(df.kind == r.kind).select("v").collect())
        assert r.n == len(values)
        for i, p in enumerate((0.05, 0.5, 0.95)):
            assert abs(sum(v <= r[f"p{i}"] for v in values) / len(values) - p) < 2 * quantiles.rank_error(400)


def test_sketches_of_a_stream_add_up(spark, tmp_path):
    where = str(tmp_path / "in")
    rows = spark.range(1000).selectExpr("timestamp_seconds(id * 60) AS ts", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS event_type", "double(id % 50) AS value")
    rows.write.parquet(where)
    query = events.latencies(spark.readStream.schema(rows.schema).parquet(where)).writeStream.outputMode("complete").format("memory").queryName("sketched").start()
    query.processAllAvailable()
    query.stop()
    whole = quantiles.merged(spark.table("sketched").select("event_type", "n", "sketch"), ["event_type"])
    got = {r.event_type: (r.n, r.p) for r in whole.select("event_type", "n", quantiles.estimate(F.col("sketch"), 0.5).alias("p")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"a": 334, "b": 666} and all(abs(p - 24.5) < 3 for _, p in got.values())

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import ordering


@pytest.mark.parametrize("width,fan", [(1000, 1000), (7, 3), (1, 2)])
def test_ranks_through_any_number_of_levels(spark, width, fan):
    draw = random.Random(width)
    values = draw.sample(range(-500, 3000), 400)
    df = spark.createDataFrame([(v, f"x{v}") for v in values] + [(None, "none")], "o long, s string").repartition(5)
    got = {r.o: r["rank"] for r in ordering.global_rank(df, "o", width=width, fan=fan).collect()}
    assert got.pop(None) is None and got == {v: i for i, v in enumerate(sorted(values))}
    assert ordering.global_rank(df.limit(0), "o").collect() == []


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_the_row_before_across_ranges(spark, width):
    draw = random.Random(width)
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), i, draw.choice([None, f"v{i}"])) for i in draw.sample(range(-200, 900), 500)] + [("hot", None, "x")]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(6)
    want = df.where("o IS NOT NULL").withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("o"))).collect()
    got = ordering.before(df, ["k"], "o", "v", width=width).collect()
    assert sorted(map(repr, (tuple(r) for r in got if r.o is not None))) == sorted(map(repr, (tuple(r) for r in want))) and [tuple(r) for r in got if r.o is None] == [("hot", None, "x", None)]

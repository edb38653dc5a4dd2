import pytest
from pyspark.sql import functions as F

from siltstone.streaming import events


def test_outcomes_move_a_work_item():
    state = ("pending", 0, 0.0)
    for outcome, want in [("claim", "in_progress"), ("error", "retry"), ("claim", "in_progress"), ("error", "retry"), ("claim", "in_progress"), ("error", "failed"), ("ok", "failed")]:
        state = events.moved(state[0], state[1], outcome, 100.0, 3, 30.0, 3600.0)
        assert state[0] == want


@pytest.fixture
def stream(spark, tmp_path):
    data = [(1, "2024-01-01 00:00:00", "a", 1.0, 7), (2, "2024-01-01 00:10:00", "a", 2.0, 7), (3, "2024-01-01 02:00:00", "b", 3.0, 8)]
    df = spark.createDataFrame(data, "event_id long, ts string, event_type string, value double, user_id long").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value", "user_id")
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def result(spark, df, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName("out").start()
    query.processAllAvailable()
    query.stop()
    return spark.sql("select * from out")


def test_windows(spark, stream):
    assert sorted((r.event_type, r.n, r.total) for r in result(spark, events.tumbling(stream), "complete").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_work_queue_state(spark, stream):
    outcomes = stream.selectExpr("user_id as key", "case when event_type = 'a' then 'claim' else 'skip' end as outcome", "cast(event_id as double) as at")
    assert sorted((r.key, r.state, r.attempts, r.changes) for r in result(spark, events.work_queue(outcomes), "update").collect()) == [(7, "in_progress", 2, 2), (8, "skipped", 0, 1)]


def test_upserts_resume(spark, stream, tmp_path):
    for _ in range(2):
        events.into_table(stream.select("user_id", "event_type", "event_id"), str(tmp_path / "t"), ["user_id"], ["event_id"], str(tmp_path / "c")).awaitTermination()
    there = lambda: sorted((r.user_id, r.event_type) for r in events.current(spark, str(tmp_path / "t")).collect())
    assert there() == [(7, "a"), (8, "b")]
    later = spark.createDataFrame([(9, "2024-01-02 00:00:00", None, 1.0, 8), (8, "2024-01-02 00:00:00", "z", 1.0, 8)], "event_id long, ts string, event_type string, value double, user_id long")
    later.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "value", "user_id").write.mode("append").parquet(str(tmp_path / "in"))
    events.into_table(stream.select("user_id", "event_type", "event_id"), str(tmp_path / "t"), ["user_id"], ["event_id"], str(tmp_path / "c")).awaitTermination()
    assert there() == [(7, "a"), (8, None)]

"""Structured Streaming over events and work queues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators.quantiles import sketches
from siltstone.operators.relational import upsert

#: States of a work item, which ones end it, and how an outcome moves it on.
TERMINAL = ("done", "failed", "skipped")
QUEUE = "key long, state string, attempts int, next_retry_at double, changes long"


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each event type in fixed windows; later events than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def latencies(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A sketch of ``value`` for each event type and window, to be stored, merged and asked: see :mod:`siltstone.operators.quantiles`."""
    return sketches(events.withWatermark("ts", late), [F.window("ts", size), F.col("event_type")], "value")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Retried requests count once: repeats of a key within the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def live(heartbeats: DataFrame, key: str, now: str, stale_after: int) -> DataFrame:
    """Latest heartbeat of each key and whether it is recent enough (batch)."""
    last = heartbeats.groupBy(key).agg(F.max("ts").alias("last"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return last.select(key, age.alias("age"), (age <= stale_after).alias("live"))


def moved(state: str, attempts: int, outcome: str, at: float, most: int, base: float, cap: float) -> tuple[str, int, float]:
    """State, attempts and retry time of a work item after an outcome: claim, ok, skip or error."""
    if state in TERMINAL:
        return state, attempts, 0.0
    if outcome == "claim":
        return "in_progress", attempts + 1, 0.0
    if outcome == "ok":
        return "done", attempts, 0.0
    if outcome == "skip":
        return "skipped", attempts, 0.0
    if attempts >= most:
        return "failed", attempts, 0.0
    return "retry", attempts, at + min(base * 2 ** max(0, attempts - 1), cap)


def work_queue(outcomes: DataFrame, most: int = 3, base: float = 30.0, cap: float = 3600.0) -> DataFrame:
    """State of every work item (key, outcome, at) as its outcomes stream in."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        state, attempts, retry, changes = store.get if store.exists else ("pending", 0, 0.0, 0)
        for part in parts:
            for outcome, at in part.sort_values("at")[["outcome", "at"]].itertuples(index=False):
                state, attempts, retry = moved(state, attempts, outcome, at, most, base, cap)
                changes += 1
        store.update((state, attempts, retry, changes))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "attempts": [attempts], "next_retry_at": [retry], "changes": [changes]})

    return outcomes.groupBy("key").applyInPandasWithState(step, QUEUE, "state string, attempts int, next_retry_at double, changes long", "update", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upsert each micro-batch of all that is there into a Parquet table of key buckets; read it by :func:`current`.

    Of a key's rows in a batch the one greatest in ``order`` counts, so a batch that runs again
    writes the same. Batch n writes only the buckets that it touches, as version n, whole before it counts; what
    no longer is the newest or the one before goes.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        own = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")
        values = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order, *values)).alias("_row")).select(*keys, "_row.*")
        newest = newest.select(*batch.columns).withColumn("bucket", own).persist()
        touched = [r[0] for r in newest.select("bucket").distinct().collect()]  # buckets at most
        old = current(spark, path, n)
        merged = newest if old is None else upsert(old.where(F.col("bucket").isin(touched)), newest, [*keys, "bucket"])
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/version={n}")
        newest.unpersist()
        _prune(spark, path, n)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, before: int) -> dict[int, list[int]]:
    """Buckets and the whole versions below ``before`` that hold them, oldest first."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    names = [f.getPath().getName() for f in fs.listStatus(make(path))] if fs.exists(make(path)) else []
    for n in sorted(int(x[8:]) for x in names if x.startswith("version=") and fs.exists(make(f"{path}/{x}/_SUCCESS"))):
        if n < before:
            for f in fs.listStatus(make(f"{path}/version={n}")):
                if f.getPath().getName().startswith("bucket="):
                    found.setdefault(int(f.getPath().getName()[7:]), []).append(n)
    return found


def current(spark: SparkSession, path: str, before: int = 1 << 62) -> DataFrame | None:
    """The newest version of each bucket of a table of :func:`into_table`; None before the first."""
    newest = [f"{path}/version={v[-1]}/bucket={b}" for b, v in sorted(_versions(spark, path, before).items())]
    return spark.read.option("basePath", path).parquet(*newest).drop("version") if newest else None


def _prune(spark: SparkSession, path: str, n: int) -> None:
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, versions in _versions(spark, path, n + 1).items():
        for old in versions[:-2]:
            fs.delete(make(f"{path}/version={old}/bucket={bucket}"), True)

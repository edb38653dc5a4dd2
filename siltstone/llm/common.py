"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.graph import connected_components as components
from siltstone.storage import cut, fresh_path, shared_dir

__all__ = ["components", "cut", "drop", "fresh_path", "grid", "shared_dir", "sliced", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of ``rows`` at most from here on in this session.

    A batch of ten thousand texts is tens of megabytes, in the JVM's direct memory and again in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``size`` bytes of text (a longer text is alone).

    What a worker makes of a slice in Python then stays small, however large Spark's batches are.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def grid(members: DataFrame, key: str, item: str, cap: int, cell_rows: int) -> DataFrame:
    """Deal the members of each ``key`` out to bounded cells that meet every pair once.

    ``members`` has one row per (key, item). A key with more than ``cap``
    members is cut into chunks and every pair of chunks gets its own block, so
    no task gets a whole heavy key. Adds ``lo``, ``hi`` (the block), ``chunk``
    (the row's own chunk) and ``cell``: about ``cell_rows`` rows to group on. Keys
    with one member have no pair and go.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    chunks = F.ceil(F.col("members") / cap).cast("int")
    dealt = (
        members.join(sizes, key)
        .withColumn("chunk", F.pmod(F.xxhash64(item, F.lit(17)), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("lo", F.least("chunk", "other"))
        .withColumn("hi", F.greatest("chunk", "other"))
    )
    rows = sizes.agg(F.coalesce(F.sum(F.col("members") * chunks), F.lit(0))).first()[0]
    cells = max(1, -(-rows // cell_rows))
    return dealt.withColumn("cell", F.pmod(F.xxhash64(key, "lo", "hi"), F.lit(cells)).cast("int")).drop("members", "other")

"""The folder that driver and executors share, and tables cut there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it.

    ``spark.checkpoint.dir`` is the cluster's setting. Where nobody set one, a local
    session, whose executors are this machine, makes a temporary folder and keeps it; a cluster is told to set it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the JVM's file system closes."""
    path = f"{shared_dir(spark).rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files.

    A lost executor then costs no recomputation of what stands before, unlike a
    local checkpoint.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`cut` that nothing reads any more; any other table's stay."""
    spark = df.sparkSession
    files = df.inputFiles()
    own = f"{shared_dir(spark).rstrip('/')}/siltstone/"
    if files and own.split("://")[-1].split(":", 1)[-1] in files[0]:
        where = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is read from fewer files than there are cores; else as it is.

    Rows are moved for small tables only: a large one has more files than the cluster has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

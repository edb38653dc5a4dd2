"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens): version is the SHA-256 of the
tokenizer file, digest the SHA-256 of the normalised text. Texts are joined to
it by both; each distinct text that it lacks is encoded once and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from siltstone.llm.common import fresh_path, sliced
from siltstone.llm.tokens import Pieces

_CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def _stored(df: DataFrame, path: str, version: str) -> DataFrame:
    """Counts of this tokenizer in the cache, one a digest; none where the cache doesn't exist yet."""
    spark = df.sparkSession
    try:
        table = spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.range(0).select(F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_tokens"))
    return table.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512, spaced: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text).

    ``path``: file of a tokenizers-library tokenizer; ``cache``: path of the cache,
    a fresh one in the shared folder if none is given. Normalising is what can't
    change a count: null is the empty text. An empty text has no token.
    Special strings inside texts count as the library takes them, as one
    token. Repeated texts are encoded once; every row, repeated or without doc_id,
    returns one. An empty table gives an empty result. Other columns are not
    read.

    Each task keeps one row a digest before the shuffle, so a text that a third of
    all rows share reaches the encoding stage once from each task.
    """
    version = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    where = cache or fresh_path(docs.sparkSession, "token-cache")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, spaced)
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces.counts(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(_stored(docs, where, version).select("digest"), "digest", "left_anti")
    fresh = misses.mapInArrow(count, "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(where)

    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(_stored(docs, where, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

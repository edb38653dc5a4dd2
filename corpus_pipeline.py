"""A pipeline over ``documents``: toxic texts go, near-duplicates go, sources are mixed, texts are encoded.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. It is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of ``documents``, and others that ``docs`` has, whatever their names.

Texts are read whole, however long. A null text counts as an empty one: it isn't toxic, repeats nothing and
has no tokens. Rows without doc_id are judged by their texts, are no one's duplicates and keep places
of their own; of rows that repeat a doc_id one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, minhash, mixing, toxicity
from siltstone.llm.common import cut
from siltstone.llm.tokens import public_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; equal texts, null and empty ones too, fare alike."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Null, empty and white texts all stay."""
    return minhash.deduplicated(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in mixing order, by the square root of each source's size; a null source is one of its own."""
    return mixing.in_mixing_order(docs)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``position`` of ``docs``: rises in the order in which the stage before wrote its rows.

    Spark deals files out to tasks by size, so the order is that of part numbers and
    of rows in a part. A table that is not read from files has the order of its partitions.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    try:
        return docs.select("doc_id", "text", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias("position"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("position"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of the text that they decode to, sorted by ``position`` in the mixture."""
    path = public_path("word_bpe_49k.json")
    coded = bpe.encode(placed(docs), path, carried=("position",), decoded=True)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "position")
    # written first: ranges are drawn from a sample, which would encode all texts twice
    return cut(coded, "coded").repartitionByRange("position").sortWithinPartitions("position")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_texts),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

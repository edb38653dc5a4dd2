"""Files as tables: Markdown, JSON lines, YAML and JSON documents, versioned Parquet snapshots."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.hashing import ordered_digest
from siltstone.operators.relational import manifest


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(doc_path, text) of the Markdown files directly in a folder, a row a file."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(root)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("doc_path"), F.col("value").alias("text"))


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """(doc_path, ordinal, heading_path, text, links, last_verified, chunk_hash): leaf sections of Markdown texts.

    A section is a heading with the lines up to the next heading; its path joins the
    headings above it. Headings inside fenced code are text. Sections without text go.
    """
    lines = docs.select("doc_path", F.posexplode(F.split("text", "\\r?\\n")).alias("at", "line"))
    w = "PARTITION BY doc_path ORDER BY at"
    fenced = lines.selectExpr("*", rf"sum(cast(line rlike '^\\s*(```|~~~)' as int)) OVER ({w}) % 2 = 1 AS fenced")
    level = F.when(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)))
    marked = fenced.withColumn("level", level).withColumn("title", F.when(level.isNotNull(), F.trim(F.regexp_replace("line", r"^#{1,6}\s+|\s+#+\s*$", ""))))
    numbered = marked.selectExpr("*", f"sum(cast(level IS NOT NULL as int)) OVER ({w}) AS section")
    for i in range(1, 7):
        # the last heading of this level, unless one above it came later
        seen = f"last(CASE WHEN level <= {i} THEN struct(level, title) END, true) OVER ({w})"
        numbered = numbered.selectExpr("*", f"{seen} AS s{i}").withColumn(f"h{i}", F.when(F.col(f"s{i}.level") == i, F.col(f"s{i}.title"))).drop(f"s{i}")
    path = F.concat_ws(" > ", *[f"h{i}" for i in range(1, 7)])
    body = F.collect_list(F.when(F.col("level").isNull(), F.struct("at", "line")))
    sections = numbered.withColumn("path", path).groupBy("doc_path", "section").agg(F.min("at").alias("start"), F.max_by("path", F.coalesce("level", F.lit(0))).alias("heading_path"), F.array_sort(body).alias("body"))
    text = F.btrim(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), F.lit(" \n\t"))
    rows = sections.select("doc_path", F.col("section").alias("ordinal"), "heading_path", text.alias("text")).where("text <> ''")
    links = F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[^\s\)\]>]+"), 0))
    verified = F.regexp_extract("text", r"(?i)(?:last verified|最后核验|核验日期)[^0-9]{0,8}(\d{4}-\d{2}-\d{2})", 1)
    return rows.select("*", links.alias("links"), F.when(verified != "", verified).alias("last_verified"), F.sha2(F.col("text").cast("binary"), 256).alias("chunk_hash"))


def knowledge_version(chunks: DataFrame) -> DataFrame:
    """One row (content_hash, version) of the chunks' sorted hashes, digested in buckets by their first digits."""
    parts = chunks.groupBy(F.substring("chunk_hash", 1, 3).alias("bucket")).agg(ordered_digest(F.col("chunk_hash"), F.col("chunk_hash")).alias("digest"))
    return parts.agg(ordered_digest(F.col("bucket"), F.col("digest")).alias("content_hash")).select("content_hash", F.concat(F.lit("kb-v1-"), F.substring("content_hash", 1, 12)).alias("version"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a schema; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(path: str, required: list[str]) -> tuple[dict, str]:
    """A YAML or JSON control file and the digest of its canonical form; missing keys are an error."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(raw)
    else:
        import yaml

        found = yaml.safe_load(raw)
    missing = sorted(set(required) - set(found))
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    canonical = json.dumps(found, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return found, hashlib.sha256(canonical.encode()).hexdigest()


def write_snapshot(df: DataFrame, root: str, key: str) -> str:
    """Write ``df`` under the digest of its rows; a snapshot that is there is used again. Returns its path."""
    spark = df.sparkSession
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    digest = manifest(df.withColumn("_all", F.lit("all")), "_all", F.col(key), payload).first()
    path = f"{root}/snapshot={digest['checksum'] if digest else hashlib.sha256(b'').hexdigest()}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return path


def _pointers(spark: SparkSession, pointer: str) -> list[int]:
    """Numbers of the pointers that were written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(pointer).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(pointer)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(pointer))]
    return sorted(int(n[3:]) for n in names if n.startswith("at=") and fs.exists(path(f"{pointer}/{n}/_SUCCESS")))


def promote(spark: SparkSession, pointer: str, version: str) -> None:
    """Make ``version`` the active one: a pointer behind those that are there, which counts once it is written whole.

    A crash on the way leaves the version before active.
    """
    n = max(_pointers(spark, pointer), default=0) + 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{pointer}/at={n}")


def active(spark: SparkSession, pointer: str) -> str | None:
    """The version that was promoted last; None before the first."""
    there = _pointers(spark, pointer)
    return spark.read.parquet(f"{pointer}/at={there[-1]}").first()["version"] if there else None

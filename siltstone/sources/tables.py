"""Versioned tables: partitions of Parquet files that are merged, replaced or deleted by copy on write.

A change writes new files for the partitions that it touches, and counts once the manifest of the next
version is there, which lists the files of every partition. Files are never changed, so a reader keeps the
version that it began with, untouched partitions keep their very files, and a writer that dies on
the way leaves files that nothing lists. A version is written once: of two writers that began
with the same one, the second is refused and has to begin again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators.relational import upsert
from siltstone.storage import cut


class Conflict(RuntimeError):
    """Another writer made the version that this one was to be."""


@dataclass(frozen=True)
class Version:
    """What a manifest says: the files, and rows, of each partition."""

    number: int
    schema: StructType | None
    files: dict[str | None, dict[str, int]]  # partition value -> file -> rows

    def rows(self) -> int:
        return sum(sum(f.values()) for f in self.files.values())


class VersionedTable:
    """A table in the folder ``path``, in partitions by the column ``by``, whose values are compared as strings.

    The manifest is a line a file: with files of a usual size a table of 100 TB has about a million.
    """

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions

    def versions(self) -> list[int]:
        where = self._make(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest; number 0 is the empty table before the first."""
        there = self.versions()
        number = number if number is not None else max(there, default=0)
        if number == 0:
            return Version(0, None, {})
        if number not in there:
            raise ValueError(f"no version {number} in {self.path}")
        lines = [r[0] for r in self.spark.read.text(f"{self.path}/versions/{number:012}.json").collect()]
        files: dict[str | None, dict[str, int]] = {}
        for line in lines[1:]:
            value, name, rows = json.loads(line)
            files.setdefault(value, {})[name] = rows
        return Version(number, StructType.fromJson(json.loads(lines[0])), files)

    def read(self, number: int | None = None, partitions: list[str | None] | None = None) -> DataFrame | None:
        """The rows of a version, of all or the named partitions; None for the empty table."""
        of = self.version(number)
        return self._read(of, of.files if partitions is None else partitions)

    def _read(self, of: Version, partitions) -> DataFrame | None:
        if of.schema is None:
            return None
        names = [f"{self.path}/data/{f}" for p in partitions for f in of.files.get(p, {})]
        if not names:
            return self.spark.createDataFrame([], of.schema)
        return self.spark.read.schema(of.schema).parquet(*names)

    def _commit(self, base: Version, schema: StructType, files: dict[str | None, dict[str, int]]) -> Version:
        number = base.number + 1
        lines = [json.dumps(schema.jsonValue())] + [json.dumps([p, f, n]) for p, fs in files.items() for f, n in sorted(fs.items())]
        final, draft = self._make(f"{self.path}/versions/{number:012}.json"), self._make(f"{self.path}/versions/draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(draft.getParent())
        out = self._fs.create(draft)
        out.write(("\n".join(lines) + "\n").encode())
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # refuses a target that is there, in one step where the store can
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as problem:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(problem.java_exception):
                raise Conflict(f"version {number} of {self.path} is another writer's") from None
            raise
        return Version(number, schema, files)

    # -- changes

    def _write(self, rows: DataFrame) -> dict[str | None, dict[str, int]]:
        """Write ``rows`` to new files, each of one partition; a large partition gets several."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        # a copy names the folders, so that files hold all columns and can be read by themselves
        named = rows.withColumn("_of", F.sha2(F.coalesce(F.concat(F.lit("="), F.col(self.by).cast("string")), F.lit("")).cast("binary"), 256))
        named.hint("rebalance", F.col("_of")).write.partitionBy("_of").parquet(folder)
        if self._fs.globStatus(self._make(f"{folder}/*/*.parquet")) is None or not len(self._fs.globStatus(self._make(f"{folder}/*/*.parquet"))):
            return {}
        back = self.spark.read.schema(rows.schema).parquet(folder)
        found: dict[str | None, dict[str, int]] = {}
        name = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32}/.*)$", 1)
        for r in back.select(F.col(self.by).cast("string").alias("value"), name.alias("file")).groupBy("value", "file").count().collect():
            found.setdefault(r["value"], {})[r["file"]] = r["count"]
        return found

    def replace(self, rows: DataFrame, partitions: list | None = None, base: Version | None = None) -> Version:
        """Put ``rows`` in place of the named partitions, by default of those that occur in ``rows``.

        A named partition without rows is empty after it. ``rows`` of other partitions are refused.
        """
        base = base or self.version()
        self._same(base, rows)
        written = self._write(rows if base.schema is None else rows.select(base.schema.names))
        gone = set(written) if partitions is None else {None if p is None else str(p) for p in partitions}
        if stray := set(written) - gone:
            raise ValueError(f"rows of other partitions: {sorted(map(str, stray))[:5]}")
        files = {p: f for p, f in base.files.items() if p not in gone} | written
        return self._commit(base, base.schema or rows.schema, files)

    def append(self, rows: DataFrame, base: Version | None = None) -> Version:
        """Add ``rows`` in new files beside those that are there."""
        base = base or self.version()
        self._same(base, rows)
        files = {p: dict(f) for p, f in base.files.items()}
        for p, f in self._write(rows if base.schema is None else rows.select(base.schema.names)).items():
            files.setdefault(p, {}).update(f)
        return self._commit(base, base.schema or rows.schema, files)

    def delete(self, partitions: list, base: Version | None = None) -> Version:
        """Empty the named partitions."""
        base = base or self.version()
        gone = {None if p is None else str(p) for p in partitions}
        return self._commit(base, base.schema or StructType(), {p: f for p, f in base.files.items() if p not in gone})

    def merge(self, rows: DataFrame, keys: list[str], base: Version | None = None) -> tuple[Version, dict[str, int]]:
        """Insert ``rows`` or put them in place of those with the same ``keys``, among which the partition's column must be.

        Only partitions that occur in ``rows`` are written again. Of rows that repeat a key the greatest counts, by all columns.
        Returns the version and how many keys were inserted, updated, and met as they are.
        """
        if self.by not in keys:
            raise ValueError(f"a row can't change its partition: {self.by} must be a key")
        base = base or self.version()
        self._same(base, rows)
        names = base.schema.names if base.schema else rows.columns
        values = [c for c in names if c not in keys]
        one = rows.select(names).groupBy(*keys).agg(F.max(F.struct(*values)).alias("_row")).select(*keys, "_row.*").select(names) if values else rows.select(names).distinct()
        one = cut(one, "merged")
        touched = [r[0] for r in one.select(F.col(self.by).cast("string")).distinct().collect()]  # partitions at most
        old = self._read(base, touched)
        if old is None:
            old = self.spark.createDataFrame([], one.schema)
        a, b = old.alias("a"), one.alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        same = F.lit(True)
        for c in values:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        met = b.join(a, on).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(same.cast("long")), F.lit(0)).alias("same")).first()
        written = self._write(upsert(old, one, keys))
        version = self._commit(base, base.schema or rows.select(names).schema, {p: f for p, f in base.files.items() if p not in set(touched)} | written)
        return version, {"inserted": one.count() - met["n"], "updated": met["n"] - met["same"], "unchanged": met["same"]}

    def _same(self, base: Version, rows: DataFrame) -> None:
        if self.by not in rows.columns or (base.schema is not None and sorted((f.name, f.dataType.simpleString()) for f in base.schema) != sorted((f.name, f.dataType.simpleString()) for f in rows.schema)):
            raise ValueError(f"rows have other columns than {self.path}")

    # -- upkeep

    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the newest ``keep``, and the files that none of these lists; not beside a writer. Returns how many files went."""
        there = self.versions()
        wanted = {f for n in there[-keep:] for fs in self.version(n).files.values() for f in fs}
        for n in there[:-keep]:
            self._fs.delete(self._make(f"{self.path}/versions/{n:012}.json"), False)
        gone = 0
        for folder in self._fs.listStatus(self._make(f"{self.path}/data")) if self._fs.exists(self._make(f"{self.path}/data")) else []:
            name = folder.getPath().getName()
            files = [f.getPath() for f in self._fs.globStatus(self._make(f"{self.path}/data/{name}/*/*.parquet")) or []]
            stale = [f for f in files if f"{name}/{f.getParent().getName()}/{f.getName()}" not in wanted]
            gone += len(stale)
            if len(stale) == len(files):
                self._fs.delete(folder.getPath(), True)
            else:
                for f in stale:
                    self._fs.delete(f, False)
        return gone

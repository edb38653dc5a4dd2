"""SQLite files as a Spark data source, in ranges of row ids, with filters and columns taken to SQLite, and as a stream that goes on where it ended.

A table is cut into ranges of its rowid between the least and the greatest, so a large file is read by many tasks, each
along the table's own order. Ranges are planned from ids alone: where these have gaps, some are small. Tables without rowid and views are one
range. Files are opened read-only; executors must see them under the same path.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType(), "BLOB": BinaryType()}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS = 100_000  # ids in a range, unless the option ``rows`` says otherwise
BATCH = 1_000_000  # ids that a stream's batch takes of a file at most, unless the option ``batch`` says otherwise


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    """Rows of a file with ``low`` < rowid <= ``high``; all of them if both are None."""

    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


def _bounds(path: str, table: str) -> tuple[int, int] | None:
    """Least and greatest rowid of a table; None if it is empty, isn't there, or has none."""
    with _open(path) as db:
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        except sqlite3.OperationalError:
            return None
    return None if not isinstance(low, int) else (low, high)


def _there(path: str, table: str) -> list[str]:
    with _open(path) as db:
        return [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]


def _rows(part: _Range, table: str, schema: StructType, asked: list[tuple[str, str, list]]) -> Iterator[tuple]:
    """The rows of a range that all conditions in ``asked`` (column, SQL, values) hold for."""
    there = set(_there(part.path, table))
    if not there:
        return
    names = [f.name for f in schema if f.name != "source_file"]
    columns = ", ".join(f"{_quoted(n)}" if n in there else f"NULL AS {_quoted(n)}" for n in names) or "NULL"
    conditions, values = [], []
    if part.low is not None:
        conditions, values = ["rowid > ? AND rowid <= ?"], [part.low, part.high]
    for column, sql, given in asked:
        conditions.append(sql.format(_quoted(column) if column in there else "NULL"))
        values += given
    where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
    flags = [isinstance(f.dataType, BooleanType) for f in schema if f.name != "source_file"]
    with _open(part.path) as db:
        for row in db.execute(f"SELECT {columns} FROM {_quoted(table)}{where}", values):
            own = iter(bool(x) if flag and x is not None else x for x, flag in zip(row, flags, strict=False))
            yield tuple(part.path if f.name == "source_file" else next(own) for f in schema)


def _planned(path: str, table: str, low: int, high: int, rows: int) -> list[_Range]:
    """Ranges of ``rows`` ids that cover ``low`` < id <= ``high``."""
    return [_Range(path, at, min(at + rows, high)) for at in range(low, high, rows)]


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: StructType, rows: int):
        self.files, self.table, self.schema, self.rows = files, table, schema, rows
        self.asked: list[tuple[str, str, list]] = []
        self.paths: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            if self.paths is None or path in self.paths:
                ids = _bounds(path, self.table)
                out += _planned(path, self.table, ids[0] - 1, ids[1], self.rows) if ids else [_Range(path, None, None)]
        return out or [_Range(self.files[0], 0, 0)] if self.files else []

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _rows(partition, self.table, self.schema, self.asked)


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons with values go to SQLite, but for texts' order, which is not Spark's there; on source_file they choose files."""
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            simple = column in kinds and not isinstance(kinds[column], (BinaryType, BooleanType))
            ordered = simple and isinstance(kinds[column], (LongType, DoubleType)) and isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
            if column == "source_file" and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif column == "source_file":
                yield f
            elif simple and isinstance(f, (IsNull, IsNotNull)):
                self.asked.append((column, "{} IS NULL" if isinstance(f, IsNull) else "{} IS NOT NULL", []))
            elif ordered and type(f) in _SIGNS:
                self.asked.append((column, f"{{}} {_SIGNS[type(f)]} ?", [value]))
            elif simple and type(f) in (EqualTo, EqualNullSafe) and isinstance(value, str):
                self.asked.append((column, "{} = ?", [value]))
            elif simple and isinstance(f, In) and value and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in value) and len(value) <= 500:
                self.asked.append((column, f"{{}} IN ({', '.join('?' * len(value))})", list(value)))
            else:
                yield f


class _Stream(DataSourceStreamReader):
    """New rows by rowid. The offset has the last id of each file; a batch takes ``batch`` ids a file at most."""

    def __init__(self, files, table: str, schema: StructType, rows: int, batch: int, after: dict[str, int] | None):
        self.files, self.table, self.schema, self.rows, self.batch = files, table, schema, rows, batch
        self.given, self.placed = dict(after or {}), after is not None  # the ids up to which batches went, and whether that is known

    def initialOffset(self) -> dict:
        return {"last": "{}"}

    def latestOffset(self) -> dict:
        """The ids up to which the next batch goes.

        Spark doesn't tell a stream that starts its place before a batch: without ``after`` its first batch takes all that is there.
        """
        last = dict(self.given)
        for path in self.files():
            if ids := _bounds(path, self.table):
                done = last.get(path, ids[0] - 1)
                last[path] = max(done, min(ids[1], done + self.batch) if self.placed else ids[1])
        self.given, self.placed = last, True
        return {"last": json.dumps(last, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["last"]), json.loads(end["last"])
        if behind := [p for p, n in before.items() if after.get(p, n) < n]:
            raise ValueError(f"the stream went on behind its place in {behind}: give ``after`` as of the last batch, or not at all")
        self.given, self.placed = {p: max(n, self.given.get(p, n)) for p, n in after.items()}, True
        out: list[InputPartition] = []
        for path, high in after.items():
            low = before.get(path)
            if low is None:
                ids = _bounds(path, self.table)
                low = ids[0] - 1 if ids else high
            out += _planned(path, self.table, low, high, self.rows)
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _rows(partition, self.table, self.schema, [])

    def commit(self, end: dict) -> None:
        for path, n in json.loads(end["last"]).items():
            self.given[path] = max(n, self.given.get(path, n))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_files").option("table", t).load(folder or file)``, and the same with ``readStream``.

    Options: ``rows``, the ids in a range; ``columns``, a comma-separated list of those to read, in this order; ``batch``, the ids of a stream's batch;
    ``after``, as JSON, the ids that a stream is past;
    ``push``, true to take filters to SQLite, for which Spark wants ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def _files(self) -> list[str]:
        where = Path(self.options["path"])
        return sorted(map(str, where.glob("*.db"))) if where.is_dir() else [str(where)]

    def schema(self) -> StructType:
        """Columns of all files together; a column that a file lacks is null there."""
        found: dict[str, StructField] = {}
        for file in self._files():
            with _open(file) as db:
                for _, name, kind, *_ in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})"):
                    found.setdefault(name, StructField(name, _KINDS.get(kind.upper()[:4].strip(), LongType() if kind.upper().startswith("INT") else StringType())))
        if wanted := self.options.get("columns"):
            return StructType([StructField("source_file", StringType()), *(found[n.strip()] for n in wanted.split(","))])
        return StructType([StructField("source_file", StringType()), *found.values()])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _Pushing if self.options.get("push") == "true" else _Reader
        return kind(self._files(), self.options["table"], schema, int(self.options.get("rows", ROWS)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._files, self.options["table"], schema, int(self.options.get("rows", ROWS)), int(self.options.get("batch", BATCH)), json.loads(self.options.get("after", "null")))


def _options(table: str, columns: list[str] | None, rows: int) -> dict[str, str]:
    return {"table": table, "rows": str(rows)} | ({"columns": ",".join(columns)} if columns else {})


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """A table of a file, or of all files of a folder, with ``source_file``.

    Filters reach SQLite if ``spark.sql.python.filterPushdown.enabled`` is on, here and when rows are read; only ``columns`` are read.
    """
    spark.dataSource.register(SqliteSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sqlite_files").options(**_options(table, columns, rows)).option("push", push).load(path)


def stream_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, rows: int = ROWS, batch: int = BATCH, after: dict[str, int] | None = None) -> DataFrame:
    """The rows of a table as a stream in batches of ``batch`` ids a file: what is there, then what is added with greater ids.

    With a checkpoint a query that was stopped goes on after the last batch that it finished. ``after`` says up to which id each file
    was read, as the sink knows it (empty at the first start): without it the first batch after a start has no bound.
    """
    spark.dataSource.register(SqliteSource)
    stream = spark.readStream.format("sqlite_files").options(**_options(table, columns, rows)).option("batch", str(batch))
    return (stream if after is None else stream.option("after", json.dumps(after))).load(path)


def capabilities(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """(table, column, present): which of the wanted tables and columns the sources have."""
    rows = []
    for name, columns in wanted.items():
        source = SqliteSource({"path": path, "table": name})
        there = set(source.schema().names)
        rows += [(name, c, c in there) for c in columns]
    return spark.createDataFrame(rows, "table string, column string, present boolean")

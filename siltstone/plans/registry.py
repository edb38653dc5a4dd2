"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """name -> query; ``sql`` has the DuckDB text of those that SQL expresses."""

    def __init__(self) -> None:
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self[f.__name__] = f
            if sql:
                self.sql[f.__name__] = " ".join(line.strip() for line in sql.strip().splitlines())
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

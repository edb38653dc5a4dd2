"""Compare queries with their SQL on DuckDB: python -m tests.oracle [sf_dir] [name...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, bool):
        return x
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, name: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if mine != theirs:
        here, there = set(mine), set(theirs)
        a, b = [r for r in mine if r not in there][:3], [r for r in theirs if r not in here][:3]
        return f"{len(mine)} against {len(theirs)} rows: {a} / {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from siltstone.session import local_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            found = differences(session, where, name, queries[name], oracle[name]) if name in oracle else f"rows only: {queries[name](session, where).count()}"
        except Exception as problem:  # report and go on with the next query
            found = f"{type(problem).__name__}: {str(problem)[:300]}"
        print(f"{name}: {found or 'ok'} ({time.time() - began:.1f} s)", flush=True)

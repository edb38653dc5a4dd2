import sqlite3

import pytest

from siltstone.sources.sqlite import read_sqlite, stream_sqlite
from siltstone.streaming.events import current, into_table


def made(path, ids, extra=""):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS people(id INTEGER PRIMARY KEY, name TEXT, score REAL, raw BLOB {extra})")
        db.executemany("INSERT INTO people(id, name, score) VALUES (?, ?, ?)", ((i, f"人{i}" if i % 5 else None, i / 4) for i in ids))
    db.close()


def test_a_million_rows_in_many_tasks(spark, tmp_path):
    made(tmp_path / "big.db", range(1, 1_000_001))
    df = read_sqlite(spark, str(tmp_path / "big.db"), "people", ["id", "name"])
    assert df.rdd.getNumPartitions() >= 8 and df.columns == ["source_file", "id", "name"]
    assert df.selectExpr("count(*) n", "sum(id) s", "count(name) k", "count(DISTINCT id) d").first()[:] == (1_000_000, 500_000_500_000, 800_000, 1_000_000)


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters_give_the_same_rows_pushed_or_not(spark, tmp_path, pushed):
    made(tmp_path / "a.db", [*range(-5, 40), 10**15])
    made(tmp_path / "b.db", range(100, 130), ", more INTEGER")
    with sqlite3.connect(tmp_path / "b.db") as db:
        db.execute("UPDATE people SET more = id * 2")
        db.execute("CREATE TABLE texts(k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
        db.executemany("INSERT INTO texts VALUES (?, ?)", [("a", "1"), ("b", None)])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        df = read_sqlite(spark, str(tmp_path), "people", rows=10**14)
        everything = [r.asDict() for r in df.collect()]
        assert len(everything) == 76 and sum(r["more"] is not None for r in everything) == 30
        a = str(tmp_path / "a.db")
        for sql, test in (
            ("id > 3 AND id <= 110", lambda r: 3 < r["id"] <= 110),
            ("name IS NULL", lambda r: r["name"] is None),
            ("name = '人7'", lambda r: r["name"] == "人7"),
            ("name > '人7'", lambda r: r["name"] is not None and r["name"] > "人7"),
            ("more IN (200, 210, 5)", lambda r: r["more"] in (200, 210, 5)),
            ("more IS NULL AND score >= 2.5", lambda r: r["more"] is None and r["score"] >= 2.5),
            (f"source_file = '{a}' AND id < 0", lambda r: r["source_file"] == a and r["id"] < 0),
            ("source_file = 'none'", lambda r: False),
            ("more <=> 200", lambda r: r["more"] == 200),
            ("NOT (id = 5) AND id < 9 AND name LIKE '人%'", lambda r: r["id"] != 5 and r["id"] < 9 and r["name"] is not None),
        ):
            got = sorted(r.id for r in df.where(sql).collect())
            assert got == sorted(r["id"] for r in everything if test(r)), sql
        assert sorted(map(tuple, read_sqlite(spark, str(tmp_path), "texts").select("k", "v").collect())) == [("a", "1"), ("b", None)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_killed_stream_goes_on_without_loss_or_repeat(spark, tmp_path):
    """Batches of 100 ids; the run dies in its fourth, goes on, and later takes what was added."""
    source, out, log = tmp_path / "s.db", str(tmp_path / "out"), str(tmp_path / "log")
    made(source, range(1, 1001))

    def run(dies_at=None, after=None):
        def write(batch, n):
            rows = batch.select("id", "name").collect()
            if n == dies_at:
                raise RuntimeError("killed")
            with open(tmp_path / "seen", "a") as f:
                f.writelines(f"{n} {r.id}\n" for r in rows)

        stream = stream_sqlite(spark, str(source), "people", ["id", "name"], rows=30, batch=100, after=after)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", log).start()

    def seen():
        return [int(x.split()[1]) for x in (tmp_path / "seen").read_text().splitlines()]

    query = run(dies_at=3, after={})
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(120)
    assert sorted(seen()) == list(range(1, 301))
    made(source, range(2001, 2050))
    query = run()
    try:
        query.processAllAvailable()
        made(source, range(3000, 3010))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen()) == [*range(1, 1001), *range(2001, 2050), *range(3000, 3010)]

    made(source, range(4000, 4600))  # the query stopped with nothing left to do
    query = run()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen()) == [*range(1, 1001), *range(2001, 2050), *range(3000, 3010), *range(4000, 4600)]

    made(source, range(5000, 5300))
    before = len({x.split()[0] for x in (tmp_path / "seen").read_text().splitlines()})
    query = run(after={str(source): 4599})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen())[-300:] == list(range(5000, 5300)) and len({x.split()[0] for x in (tmp_path / "seen").read_text().splitlines()}) == before + 3  # 700 ids, 300 of them rows
    query = run(after={str(source): 10})  # a place long past: refused, or corrected from the checkpoint
    made(source, range(6000, 6003))
    try:
        query.processAllAvailable()
    except Exception as problem:
        assert "behind its place" in str(problem)
    else:
        assert sorted(seen())[-3:] == [6000, 6001, 6002]
    finally:
        query.stop()
    assert len(seen()) == len(set(seen()))

    query = into_table(stream_sqlite(spark, str(source), "people", ["id", "name"]), out, ["id"], ["id"], str(tmp_path / "log2"))
    query.awaitTermination(120)
    assert current(spark, out).count() == 1962

import hashlib
from pathlib import Path

import pytest

from siltstone.sources.tables import Conflict, VersionedTable


def frame(spark, rows):
    return spark.createDataFrame(rows, "part string, id long, v string")


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect()))) if df is not None else None


def bytes_of(table, of, part):
    return {f: hashlib.sha256((Path(table.path) / "data" / f).read_bytes()).hexdigest() for f in of.files.get(part, {})}


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "part")
    assert t.read() is None and t.version().number == 0
    t.replace(frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "n"), ("s/=%", 7, "odd")]))
    return t


def test_merge_writes_touched_partitions_alone(spark, table):
    first = table.version()
    kept = {p: bytes_of(table, first, p) for p in ("b", None, "s/=%")}
    new = frame(spark, [("a", 2, None), ("a", 3, "z"), ("a", 1, "x"), ("c", 1, "c"), ("a", 3, "a")])
    version, counts = table.merge(new, ["part", "id"])
    assert counts == {"inserted": 2, "updated": 1, "unchanged": 1} and version.number == 2
    assert rows(table.read()) == sorted(map(repr, [("a", 1, "x"), ("a", 2, None), ("a", 3, "z"), ("b", 1, None), (None, 5, "n"), ("s/=%", 7, "odd"), ("c", 1, "c")]))
    assert {p: bytes_of(table, version, p) for p in kept} == kept
    assert rows(table.read(1)) == sorted(map(repr, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "n"), ("s/=%", 7, "odd")]))
    assert rows(table.read(partitions=["c", "none"])) == [repr(("c", 1, "c"))] and version.rows() == 7
    again, counts = table.merge(new, ["part", "id"])  # a batch that runs twice
    assert counts == {"inserted": 0, "updated": 0, "unchanged": 4} and rows(table.read(2)) == rows(table.read(3))


def test_rebuild_and_delete_partitions(spark, table):
    kept = bytes_of(table, table.version(), "a")
    version = table.replace(frame(spark, [("b", 9, "new")]), ["b", None])
    assert rows(table.read(partitions=["b", None])) == [repr(("b", 9, "new"))] and bytes_of(table, version, "a") == kept
    with pytest.raises(ValueError, match="other partitions"):
        table.replace(frame(spark, [("a", 9, "new")]), ["b"])
    table.delete(["a"])
    assert rows(table.read()) == sorted(map(repr, [("b", 9, "new"), ("s/=%", 7, "odd")]))
    table.append(frame(spark, [("b", 9, "new")]))
    assert table.read(partitions=["b"]).count() == 2


def test_of_two_writers_one_wins(spark, table):
    base = table.version()
    table.merge(frame(spark, [("a", 1, "first")]), ["part", "id"], base)
    with pytest.raises(Conflict):
        table.merge(frame(spark, [("b", 1, "second")]), ["part", "id"], base)
    assert "'first'" in str(rows(table.read())) and "second" not in str(rows(table.read()))
    table.merge(frame(spark, [("b", 1, "second")]), ["part", "id"])  # begun again
    assert "'second'" in str(rows(table.read())) and "'first'" in str(rows(table.read()))


def test_a_crash_before_the_commit_leaves_the_old_version(spark, table, monkeypatch):
    before = rows(table.read())

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.replace(frame(spark, [("a", 1, "lost")]))
    again = VersionedTable(spark, table.path, "part")
    assert rows(again.read()) == before and again.versions() == [1]
    again.replace(frame(spark, [("b", 2, "kept")]))
    assert again.vacuum(keep=1) == 2  # the lost file and the replaced one
    assert "kept" in str(rows(again.read())) and again.versions() == [2]
    with pytest.raises(ValueError):
        again.read(1)


def test_hot_partition_gets_several_files_and_columns_must_fit(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "h"), "part")
    df = spark.range(200_000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE cast(id % 5 as string) END AS part", "id", "sha2(cast(cast(id as string) as binary), 512) AS v")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        version = t.replace(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(version.files["hot"]) > 1 and version.rows() == 200_000
    with pytest.raises(ValueError, match="columns"):
        t.append(df.withColumn("more", df.id))
    with pytest.raises(ValueError, match="partition"):
        t.merge(df, ["id"])
    assert t.read().where("part = 'hot'").count() == version.rows() - t.read().where("part <> 'hot'").count()


def test_empty(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "e"), "part")
    t.replace(frame(spark, []))
    assert rows(t.read()) == [] and t.merge(frame(spark, []), ["part", "id"])[1] == {"inserted": 0, "updated": 0, "unchanged": 0}
    assert t.vacuum() == 0


def test_rounds_of_a_closure_leave_one_table(spark, tmp_path):
    from siltstone.operators import graph
    from siltstone.storage import cut, forget, shared_dir

    where = Path(shared_dir(spark).removeprefix("file:")) / "siltstone"
    chain = spark.range(100).selectExpr("id AS child", "id + 1 AS parent")
    chain.write.parquet(str(tmp_path / "own"))
    before = set(where.iterdir()) if where.exists() else set()
    assert graph.closure(spark.read.parquet(str(tmp_path / "own"))).count() == 5050
    assert len(set(where.iterdir()) - before) == 1 and spark.read.parquet(str(tmp_path / "own")).count() == 100
    before = set(where.iterdir())
    labels = graph.connected_components(chain.toDF("src", "dst"))
    assert {r.component_id for r in labels.collect()} == {0} and len(set(where.iterdir()) - before) == 1
    forget(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 100
    one = cut(chain, "one")
    forget(one)
    assert not any(p.name.startswith("one-") for p in where.iterdir())

import hashlib

import pytest

from siltstone.llm import warc

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666:0>\r\nContent-Length: {}\r\n\r\n"


def wanted(rows, least=100):
    """page_id, bytes, digest, type and reference of each row, by brute force."""
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        others = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(others, default=None)
        refers = first if len(body) >= least and first is not None and (page is None or page > first) else None
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "1 AS n", "'r' AS refers_to").repartition(parts)


def rows_with_traps():
    """Pages whose payloads look like records: magic words, whole records, and one that ends where the next record begins."""
    page = "<html>" + "long enough to be referred to " * 5 + "</html>"
    traps = [
        FAKE.format(4) + "body",
        "x" + FAKE.format(0),
        "\nWARC/1.",
        "\nWARC/1." * 500,
        "WARC/1.1\r\n\r\nWARC/1.0\r\n",
        "\r\n" * 40 + "\r\n\r",
        "a" * 120 + FAKE.format(5) + "12345",  # its successor is the true next record
        "a" * 120 + FAKE.format(3) + "abc\r\n\r\n" + "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n",
        "b" * 120 + FAKE.format(10**12),
        (FAKE.format(2) + "zz") * 30,
        "é漢😀\x00\x85 " * 40,
    ]
    rows = [(i, f"http://a.org/{i}", t) for i, t in enumerate(traps)]
    rows += [(100 + i, None if i % 3 else "http://b.org/WARC/1.1\r\nWARC-Type: x", page) for i in range(20)]
    rows += [(50, "u", None), (51, "u", ""), (52, "u", "short"), (53, "u", "short"), (100, "u", page), (None, "u", page), (None, "u", "no id " * 30), (None, "v", "no id " * 30), (-9, "u", traps[6])]
    return rows + [(1000 + i, "u", f"page {i} " * (i % 50)) for i in range(40)]


@pytest.mark.parametrize("compression,split", [("none", "128m"), ("gzip", "128m"), ("none", "2000b")])
def test_round_trip(spark, compression, split):
    rows = rows_with_traps()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split != "128m" else "4m")
        back = warc.round_trip(frame(spark, rows), compression=compression)
        got = [tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(repr, got)) == wanted(rows)


def test_payloads_and_urls_come_back(spark, tmp_path):
    rows = rows_with_traps()
    where = str(tmp_path / "w")
    warc.write_archives(frame(spark, rows), where)
    got = warc.archived_pages(spark, where).collect()
    assert len(got) == len(rows) and all((r.payload is None) == (r.record_type == "revisit") for r in got)
    whole = {r.page_id: bytes(r.payload) for r in got if r.payload is not None and r.page_id is not None}
    assert all(whole[i] == (h or "").encode() for i, _, h in rows if i in whole) and len(whole) > 50
    assert {r.url for r in got} >= {None, "u", "http://a.org/1", "http://b.org/WARC/1.1%0D%0AWARC-Type: x"}


def test_hot_payloads_by_both_ways(spark, monkeypatch):
    rows = [(i, "u", "h" * 200) for i in range(400)] + [(1000 + i, "u", f"{i // 2} " * 90) for i in range(400)]
    for heavy in (1, 4, 10**6):
        monkeypatch.setattr(warc, "HEAVY", heavy)
        got = [tuple(r) for r in warc.round_trip(frame(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(map(repr, got)) == wanted(rows)


def test_damage_is_refused_and_foreign_files_are_read(spark, tmp_path):
    record = lambda kind, body: f"WARC/1.0\r\nwarc-type:{kind}\r\nContent-length:  {len(body)}  \r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [b"first", b"", b"\xff\xfe\x00 binary \n\nWARC/1.0\r\n", b"\r\n\r\n"]
    data = b"".join(record("resource", b) for b in bodies)
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.warc").write_bytes(data)
    (tmp_path / "ok" / "b.warc").write_bytes(record("warcinfo", b"software: x"))
    got = warc.records(spark, str(tmp_path / "ok")).collect()
    assert sorted(bytes(r.content) for r in got) == sorted([*bodies, b"software: x"])
    for i, broken in enumerate((data[:-1], data[3:], data + b"x", data.replace(b"length:  5", b"length:  6"), b"no archive")):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "a.warc").write_bytes(broken)
        with pytest.raises(ValueError, match="start to end"):
            warc.records(spark, str(tmp_path / f"bad{i}"))


def test_jumps_follow_a_long_chain(spark):
    links = [("f", i, i + 1 if i < 99 else None, i + 1) for i in range(100)] + [("f", 200, 50, 50), ("g", 0, None, 9), ("h", 5, 6, 6), ("h", 6, None, 7)]
    df = spark.createDataFrame(links, "file string, run long, next long, entry long")
    assert {(r.file, r.run, r.entry) for r in warc.reached(df).collect()} == {("f", i, i) for i in range(100)} | {("g", 0, 0)}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ranges_of_a_few_bytes(spark):
    rows = [(1, "u", FAKE.format(4) + "body"), (2, "u", "\r\n\nWARC/1."), (3, None, "")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        back = [tuple(r) for r in warc.round_trip(frame(spark, rows, 1), compression="none").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(repr, back)) == wanted(rows)

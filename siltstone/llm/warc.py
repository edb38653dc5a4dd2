"""WARC archives: pages written as records, and records read from files that tasks share.

A record begins with a magic word, but so may a line of a page. Readers cut files at the
magic, each its own range, so a piece is only a candidate: its header says where the
next record would begin. Offsets come from the lengths of pieces, summed up by range and
file. Candidates that follow each other directly are contracted to runs; from the start of the
file, pointer jumping over runs finds in a logarithm of steps all that are reached,
and what is not is payload. A record that holds the magic is put together from its pieces again.
A file whose chain of records does not end where the file does is refused.

Files may be whole or compressed, record by record or at once; Spark gives a compressed file to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, fresh_path

LEAST = 100  # bytes of a payload that others may refer to
HEAVY = 1_000  # a group with over 1 / HEAVY of all rows is met by broadcast: there can't be more of them
_MAGIC = "WARC/1."
_CUT = "\n" + _MAGIC  # begins with a sign that it holds once, so no reader loses it at the end of a buffer
_END = "\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLACE = ["file", "block", "id"]


# -- writing


def with_first(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, digest, and ``refers_to``: the smallest page_id with this payload, where that is another row's.

    A null html is empty. Rows without page_id come after those with one. Payloads shorter than ``least`` bytes refer to none.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1 AND smallest IS NOT NULL")
    groups = cut(groups, "equal_payloads")
    heavy = groups.where(F.col("n") > max(1, pages.count() // HEAVY)).select("digest", F.col("smallest").alias("of_heavy"))  # HEAVY rows at most
    light = groups.select(F.col("digest").alias("key"), "smallest")
    near = rows.join(F.broadcast(heavy), "digest", "left")
    # what has its answer goes anywhere, so that a third of all rows isn't one key
    key = F.when(F.col("of_heavy").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "digest", F.coalesce("page_id", F.xxhash64("url"))))
    met = near.withColumn("key", key).join(light, "key", "left").withColumn("smallest", F.coalesce("of_heavy", "smallest"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("smallest")), F.col("smallest"))
    return met.select("page_id", "url", "html", "payload_bytes", "digest", refers.alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", compression: str = "none") -> None:
    """Write a WARC 1.1 record for each row of ``pages`` (page_id, url, html) to files in ``path``, a file a task.

    Records of payloads that occur before are revisits, without the payload. The record's id holds page_id and digest, so rows
    that repeat both are the same record written twice. Line breaks and other control signs within a URL are percent-encoded.
    ``compression``: as Spark's text writer knows it; gzip makes files that one task reads.
    """
    rows = with_first(pages, least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%20")
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit(f"{_MAGIC}1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("refers_to"), F.col("digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    # what ends a record is the writer's line end, so a file is nothing but records
    rows.withColumn("block", block).select(F.concat(head, "block").alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


# -- reading


def header(head: Column, name: str) -> Column:
    """The value of a header field, null if there is none."""
    found = F.regexp_extract(head, f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*?)[ \\t]*(?:\\r\\n|$)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the magic words of the files in ``path``: place, value and what its header says, written once.

    ``size``: bytes; ``kind``: 1 if it begins with the magic itself, 0 if with the rest of one; ``body``: bytes before the block; ``length``: bytes of the block.
    """
    raw = spark.read.option("lineSep", _CUT).option("recursiveFileLookup", "true").text(path)
    value, head = F.col("value"), F.substring_index("value", _END, 1)
    named = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value", head.alias("head"))
    kind = F.when(F.octet_length("head") < F.octet_length(value), F.when(F.col("head").rlike("^WARC/1\\.[0-9]\\r\\n"), 1).when(F.col("head").rlike("^[0-9]\\r\\n"), 0))
    length = F.regexp_extract("head", "(?i)\\r\\nContent-Length:[ \\t]*([0-9]{1,15})[ \\t]*(?:\\r\\n|$)", 1)
    parsed = named.select(*_PLACE, "value", F.octet_length(value).cast("long").alias("size"), kind.alias("kind"), (F.octet_length("head") + 4).cast("long").alias("body"), F.when(length != "", length).cast("long").alias("length"))
    where = fresh_path(spark, "warc-pieces")
    parsed.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(parsed.schema).parquet(where)


def _placed(pieces: DataFrame) -> DataFrame:
    """Place, ``at`` (bytes before the piece in its file), ``end`` of the file, ``size``, and ``to`` of candidates: where the piece of their successor would begin."""
    light = pieces.drop("value")
    rows = light.withColumn("span", F.col("size") + len(_CUT))
    ranges = rows.groupBy("file", "block").agg(F.sum("span").alias("total"))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), (F.sum("total").over(of_file) - len(_CUT)).alias("end"))
    earlier = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("span").over(earlier), F.lit(0))).join(ranges, ["file", "block"]).withColumn("at", F.col("at") + F.col("base"))
    candidate = F.col("kind") == F.when(F.col("at") == 0, 1).otherwise(0)
    return rows.select(*_PLACE, "at", "end", "size", F.when(candidate, F.col("at") + F.col("body") + F.col("length") + len(_END) + len(_MAGIC)).alias("to"))


def _runs(placed: DataFrame) -> DataFrame:
    """``placed`` with ``run``: where the chain of candidates begins in which each is the successor of the one before it in its range."""
    among = Window.partitionBy("file", "block").orderBy("id")
    follows = F.col("at") == F.lag("to").over(among)
    begun = placed.where("to IS NOT NULL").withColumn("begin", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("at")))
    run = F.last("begin", ignorenulls=True).over(among.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = placed.where("to IS NULL").withColumn("run", F.lit(None).cast("long"))
    return begun.withColumn("run", run).drop("begin").unionByName(rest)


def reached(links: DataFrame) -> DataFrame:
    """file, run, entry of all runs that are reached from offset 0 of their files, by pointer jumping.

    ``links`` has file, run, next, entry: from the end of a run the chain goes on in ``next`` at ``entry``.
    """
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    found = links.where("run = 0").select("file", "run", F.lit(0).cast("long").alias("entry")).distinct()
    jumps = links.where("next IS NOT NULL").select("file", "run", "next", "entry")
    for _ in range(int(most).bit_length()):  # the runs known to be reached double each time
        further = found.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("next").alias("run"), "entry")
        found = cut(found.unionByName(further), "warc-reached")
        second = jumps.select("file", F.col("run").alias("next"), F.col("next").alias("last"), F.col("entry").alias("last_entry"))
        jumps = cut(jumps.join(second, ["file", "next"]).select("file", "run", F.col("last").alias("next"), F.col("last_entry").alias("entry")), "warc-jumps")
    return found


def _exceptions(placed: DataFrame) -> DataFrame:
    """Place and ``owner`` of the pieces that are not a whole record: the piece with which the record begins to which they belong.

    Raises ValueError if a file's records do not reach from its start to its end.
    """
    nodes = cut(_runs(placed), "warc-nodes")
    runs = nodes.where("run IS NOT NULL").groupBy("file", "run").agg(F.max_by("to", "at").alias("entry"))
    inner = nodes.where("run IS NOT NULL").select("file", F.col("at").alias("entry"), F.col("run").alias("next"))
    links = cut(runs.join(inner, ["file", "entry"], "left"), "warc-links")
    found = reached(links)
    files = nodes.groupBy("file").agg(F.max("end").alias("end"))
    last = found.select("file", "run").join(links, ["file", "run"]).groupBy("file").agg(F.max("entry").alias("last"))
    broken = files.join(last, "file", "left").where(F.col("last").isNull() | (F.col("last") != F.col("end") + len(_MAGIC)))
    if names := [r["file"] for r in broken.select("file").limit(5).collect()]:
        raise ValueError(f"records do not reach from start to end in {names}")
    # pieces that are no candidates have a run of their own, which nothing reaches
    own = F.coalesce("run", -F.col("id") - 1)
    true = nodes.withColumn("run", own).join(found, ["file", "run"], "left").withColumn("begins", F.when(F.col("at") >= F.col("entry"), F.col("at")))
    whole = F.col("begins").isNotNull() & (F.col("to") - len(_MAGIC) - F.col("at") - F.col("size")).isin(0, 1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = true.groupBy("file", "block").agg(F.max("begins").alias("latest")).select("file", "block", F.max("latest").over(before).alias("carried"))
    up_to = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.coalesce(F.max("begins").over(up_to), "carried")
    return true.withColumn("whole", whole).join(carried, ["file", "block"]).select(*_PLACE, owner.alias("owner"), "whole").where("NOT whole").drop("whole")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, head, content for each record of the WARC files in ``path``: its header and its block as binary.

    Spark joins the exceptions by broadcast only if their files are small. No files' records: an empty result.
    """
    pieces = _pieces(spark, path)
    odd = cut(_exceptions(_placed(pieces)), "warc-exceptions")
    alone = pieces.join(odd, _PLACE, "left_anti").select("file", "value", "body", "length")
    parts = pieces.join(odd, _PLACE).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "id", "value", "body", "length"))).alias("parts"))  # one record
    joined = parts.select("file", F.array_join("parts.value", _CUT).alias("value"), F.col("parts")[0]["body"].alias("body"), F.col("parts")[0]["length"].alias("length"))
    every = alone.unionByName(joined)
    return every.select("file", F.substring_index("value", _END, 1).alias("head"), F.substring(F.col("value").cast("binary"), (F.col("body") + 1).cast("int"), F.col("length").cast("int")).alias("content"))


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload for each record that :func:`write_archives` wrote.

    A revisit has a null payload; its size and digest are those that it declares. A response whose payload has another digest than its header says stops the job.
    """
    found = records(spark, path)
    http = F.substring_index(F.col("content").cast("string"), _END, 1)
    rows = found.select("head", "content", http.alias("http"), header(F.col("head"), "WARC-Type").alias("record_type"))
    response = F.col("record_type") == "response"
    rows = rows.withColumn("payload", F.when(response, F.substring(F.col("content"), F.octet_length("http") + 5, F.octet_length("content"))))
    declared = F.substring_index(header(F.col("head"), "WARC-Payload-Digest"), ":", -1)
    page = lambda name: F.regexp_extract(header(F.col("head"), name), "urn:x-page:(-?[0-9]*):", 1)
    number = lambda x: F.when(x != "", x).cast("long")
    rows = rows.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        header(F.col("head"), "WARC-Target-URI").alias("url"),
        "record_type",
        F.when(response, F.octet_length("payload")).otherwise(header(F.col("http"), "Content-Length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(declared).alias("payload_digest"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        "payload",
        declared.alias("declared"),
    )
    checked = F.when(F.col("payload_digest") == F.col("declared"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return rows.withColumn("payload_digest", checked).drop("declared")


def dangling(pages: DataFrame) -> DataFrame:
    """refers_to, payload_digest, payload_bytes of revisits in ``pages`` to which no response with that id, digest and size belongs."""
    asked = pages.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    known = pages.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return asked.join(known, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, least: int = LEAST, compression: str = "gzip") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``pages`` (page_id, url, html), written as archives to the shared folder and read back.

    Raises ValueError if a revisit's response isn't there. A null html is an empty one; null page_ids come back as null; rows that
    repeat come back as often; other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least, compression=compression)
    back = cut(archived_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-index")
    if lost := dangling(back).take(3):
        raise ValueError(f"revisits without their response: {lost}")
    return back

"""How filters interact: what each removes, in every order in which they could run.

A row's failures are a bit mask, so whatever the order, what happens to it when filter f runs
after the set S depends on (S, f) alone. That is an edge of the lattice of subsets: five
filters have 80. Rows with equal masks are counted first, each mask adds its count to all
edges, and a permutation is a path of edges: its steps are joined to the summed edges. No
row is sent through 120 orders, and no part goes to one task.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
MOST = 6  # filters: the permutations of seven would be 5,040 for each part


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """The filters that look at one text, by letter: true where it fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        ("A", F.size(words) < 100),
        ("B", 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
        ("C", 100 * capitals > 10 * F.length(text)),
        ("D", text.rlike("[#$%&*|]")),
    ]


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: bit i of mask is set where filter i of A to E fails; n equal rows are one.

    A null text is empty, a null language the part "". E fails where a row with a smaller
    doc_id has the same text; rows without doc_id and rows that repeat one have no smaller one by themselves.
    """
    text = F.coalesce("text", F.lit(""))
    own = sum((F.when(fails, 1 << i).otherwise(0) for i, (_, fails) in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), own.cast("int").alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # a text's first row is met on text and doc_id, so a text that thousands share is no hot key
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask"), "n")


def edges(counts: DataFrame, filters: int) -> DataFrame:
    """part, applied, next and the sums of what happens when filter ``next`` runs after the set ``applied``.

    ``counts`` has part, mask, n, good, toxic. Every part has all ``filters`` * 2^(``filters`` - 1) edges.
    ``paths`` is the number of orders that contain the edge.
    """
    listed = [(s, f, factorial(k := s.bit_count()) * factorial(filters - 1 - k)) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    each = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(p).cast("long").alias("paths")) for s, f, p in listed))
    spread = counts.withColumn("edge", F.explode(each)).select("*", "edge.*")
    fails = F.col("mask").bitwiseAND(F.expr("shiftleft(1, next)")) != 0
    reached = F.col("mask").bitwiseAND(F.col("applied")) == 0
    total = lambda which, column="n": F.sum(F.when(which, F.col(column)).otherwise(F.lit(0)))
    return spread.groupBy("part", "applied", "next", "paths").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.expr("shiftleft(1, next)")).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
    )


def steps(spark, letters: str) -> DataFrame:
    """filter_order, step, applied, next: a row for each step of each order of ``letters``."""
    rows = []
    for order in permutations(range(len(letters))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``rows`` has part, mask and n (rows that it stands for), good and toxic (how many of them are). A row of the result for each
    part, order of ``letters`` and step; an empty table gives none. ``shapley`` is what the step's filter removes over all orders.
    """
    if not 0 < len(letters) <= MOST:
        raise ValueError(f"between 1 and {MOST} filters, not {len(letters)}")
    counts = rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    summed = edges(counts, len(letters))
    # a part's edges are 80 rows
    summed = summed.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "next")))
    paths = F.broadcast(steps(rows.sparkSession, letters))  # 600 rows for five filters, 4,320 for MOST
    out = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return summed.join(paths, ["applied", "next"]).select("part", "filter_order", "step", *out)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    A document is good where any of its labels has quality 1, and toxic where any has toxic 1. Null labels and documents without labels are neither. Other columns are not read.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    rows = masked(docs).join(known, "doc_id", "left")
    return audit(rows.select("part", "mask", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic"))), "ABCDE")

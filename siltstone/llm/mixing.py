"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in an order drawn by hash, are cut into blocks. While the
same sources are live, block i of a source with the share p of their weights is
released at floor((i - 1) / p) and due at i / p, and the earliest deadline among
the released blocks takes each slot. So at every slot of such a phase a source is less than
one block away from its share of the phase, however long it is and however many sources there
are: weights are never rounded to slots. When a source's last block is placed, the next phase
begins, and the others go on with the shares that they have among themselves: no
document is dropped or repeated. Over the whole run a source is less than one block a phase away from the
sum of its shares, and there is a phase a source.

The driver keeps a number a block, the source that takes the slot, and no more than
one waiting block a source. Blocks grow with the rows, so that there are ``BLOCKS`` and
one more a source at most. At the begin of a phase deadlines are in the order of weights, which no phase changes,
so only sources that had a slot in a phase cost anything there: the schedule takes
the logarithm of the sources a slot, however many phases there are. The documents are only ranked, by
counts per source and hash bucket before ranks within a bucket, so that a source
with a third of all rows is spread like any other.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut

SCALE = 1 << 62  # weights are integers that add up to about this: what that rounds stays far under a block
BLOCKS = 1 << 20  # blocks that the driver schedules, besides one a source: 4 bytes each
BUCKET_ROWS = 2_000  # mean rows of a source's hash bucket
BUCKETS = 1 << 16  # buckets of a source at most: their counts are summed up in one task


def scaled(weights: dict) -> dict:
    """Integers in the ratio of ``weights``."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: max(1, round(w * SCALE / total)) for s, w in exact.items()}


def schedule(blocks: dict, weights: dict) -> array:
    """For each slot the place in sorted(blocks) of the source that takes it: ties to the smaller place."""
    names = sorted(blocks)
    left, weight = [blocks[s] for s in names], scaled({i: weights[s] for i, s in enumerate(names)})
    due = lambda i, s: (i << 128) // weight[s]  # noqa: E731  # in units of a phase's length by its weights: the same in all phases
    order = sorted((due(1, s), s) for s in range(len(names)) if left[s])  # first blocks, as every phase begins
    after = list(range(1, len(order) + 1))  # the next in ``order`` that is live, behind the place before the first
    live_from, total, out = 0, sum(weight[s] for _, s in order), array("i")
    place = {s: n for n, (_, s) in enumerate(order)}
    before = list(range(-1, len(order) - 1))
    while live_from < len(order):
        waiting, ready, t, fresh, ended = [], [], 0, live_from, None
        while ended is None:
            while waiting and waiting[0][0] <= t:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due(i, s), s, i))
            if fresh < len(order) and not (ready and ready[0][:2] < order[fresh]):
                s, i, fresh = order[fresh][1], 1, after[fresh]
            else:
                _, s, i = heapq.heappop(ready)
            out.append(s)
            left[s] -= 1
            t += 1
            if left[s]:
                heapq.heappush(waiting, (i * total // weight[s], s, i + 1))
            else:
                ended = s
        n = place[ended]
        total -= weight[ended]
        if before[n] >= 0:
            after[before[n]] = after[n]
        else:
            live_from = after[n]
        if after[n] < len(order):
            before[after[n]] = before[n]
    return out


def _plan(blocks: dict, weights: dict) -> pa.Table:
    """name, block, slot: a row for each block."""
    taken = np.frombuffer(schedule(blocks, weights), np.int32)
    order = np.argsort(taken, kind="stable")  # slots of a source after another, in order
    sizes = np.bincount(taken)
    block = np.arange(len(taken)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pa.table({"name": pa.array(sorted(blocks), pa.string()).take(pa.array(taken[order])), "block": block, "slot": order})


def mixed(docs: DataFrame, weights: dict | None = None, block: int = 16, smoothing: float = 0.5, seed: int = 11, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, slot, position for each row of ``docs`` (doc_id, source).

    ``slot`` numbers the blocks of ``block`` documents in mixing order, ``position`` is
    slot * block plus the place in the block: sorting by it gives the mixture. A
    source's last block may hold fewer documents, so positions may skip numbers. Over
    BLOCKS blocks of so many documents a block holds more.
    ``weights``: target weight of each source (others get the smallest); by default a
    source's number of rows to the power ``smoothing``. A null source is a source like
    any other. Rows that repeat or have no doc_id have places of their own. An
    empty table gives an empty result. Other columns are not read, but for ``carried``, which tell rows apart and are returned too.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *carried)
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    # rows without doc_id are alike but for ``carried``, so which of them takes which place says nothing
    alike = F.xxhash64(*carried) if carried else F.monotonically_increasing_id()
    keyed = keyed.withColumn("name", name).withColumn("draw", F.xxhash64(F.coalesce("doc_id", alike), F.lit(seed)))
    sizes = {r["name"]: r["n"] for r in keyed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    if not sizes:
        return keyed.select("doc_id", "source", *carried, F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("position"))
    if weights is None:
        target = {s: Fraction(n**smoothing).limit_denominator(10**6) for s, n in sizes.items()}
    else:
        named = {"" if s is None else f"={s}": w for s, w in weights.items() if w > 0}
        target = {s: named.get(s, min(named.values(), default=1)) for s in sizes}
    block = max(block, -(-sum(sizes.values()) // BLOCKS))
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    plan = spark.createDataFrame(_plan(blocks, target))

    buckets = min(BUCKETS, max(1, -(-sum(sizes.values()) // BUCKET_ROWS)))
    keyed = keyed.withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n")).select("name", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("name", "bucket").orderBy("draw", "doc_id", *carried)
    ranked = keyed.withColumn("rank", F.row_number().over(within)).join(offsets, ["name", "bucket"]).withColumn("rank", F.col("offset") + F.col("rank") - 1)
    numbered = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))

    # a key is a block: no task gets a whole source
    slot = F.col("slot")
    return numbered.join(plan, ["name", "block"]).select("doc_id", "source", *carried, slot, (slot * block + F.pmod(F.col("rank"), F.lit(block))).alias("position"))


def _located(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_file and mix_row, where each row stands; what isn't read from files is written first."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        return _located(cut(docs, "docs"))


def in_mixing_order(docs: DataFrame, weights: dict | None = None, block: int = 16) -> DataFrame:
    """``docs`` range-partitioned and sorted in mixing order.

    Files written from it hold that order by part number and row in a part; Spark reads files by size, so a
    reader has to sort by these. Columns and rows stay as they are; rows are told apart by where they stand,
    so those that repeat a doc_id or have none are dealt out like others.
    """
    rows = _located(docs)
    place = ("mix_file", "mix_row")
    places = cut(mixed(rows, weights, block, carried=place).select(*place, F.col("position").alias("mix_position")), "places")
    return rows.join(places, list(place)).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(docs.columns)

"""A stored inverted index for BM25: text is read once, when documents are added.

A segment holds, for documents that were added together, their counted tokens and postings
in blocks. A block is the postings of one token that weigh about as much, with the greatest
weight among them in its head, so a search knows from heads alone how much a block can add
to a score. A search opens blocks of a query until what the closed ones could add together
stays below the score of its k-th document: no document without a posting in an opened block can then
be among the first k. Those that can are scored exactly from their own counted tokens. Queries whose bounds rule
too few documents out scan all counted tokens together, in blocks.

Weights depend on the mean length, which later segments change. A weight
grows by no more than the mean did, so heads stay bounds when multiplied by that; ``merge``
writes segments anew as one. What segments there are is a versioned table, so readers see whole ones only.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.functions.text import CJK, fold_text
from siltstone.operators.relational import top_per_key
from siltstone.sources.tables import VersionedTable
from siltstone.storage import cut, spread

K1, B = 1.5, 0.75
LEVELS = 40  # steps of weight between 0 and K1 + 1 in which postings of a token share a block
BLOCK = 4_096  # postings of a frequent token in a block at most, about; most levels hold fewer
FREQUENT = 50_000  # tokens with a share of over 1 / FREQUENT of all postings: there can't be more, so they are broadcast
SHARD = 10_000_000  # documents among which a token's postings of a level may share a block
PROBE = 8  # postings that the first round opens for each of the k documents wanted
POSTINGS = 2**18  # counted tokens that a block of a whole scan holds, as a mean
PART = 1_024  # queries that meet a block at once, as a mean
CELLS = 2**20  # scores, and pairs of a posting and a query, that a block holds at once
SCAN = 4  # a search that would open more postings than a quarter of the documents scans them instead
_SLACK = 2e-6  # scores are rounded to six digits before they are ranked
_RUNS = re.compile(f"[A-Za-z0-9_]+|[{CJK}]+")
_HAN = re.compile(f"[{CJK}]")


def paired(runs: list[str]) -> list[str]:
    """Words as they are, a run of Han signs as its signs and its pairs of signs."""
    out = []
    for run in runs:
        if _HAN.match(run):
            out.extend(run)
            out.extend(run[i : i + 2] for i in range(len(run) - 1))
        else:
            out.append(run)
    return out


def tokens_of(text: str, pairs: bool = True) -> list[str]:
    """Words of folded text, and its runs of Han signs, in pairs or whole."""
    runs = _RUNS.findall(fold_text(text))
    return paired(runs) if pairs else runs


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, tokens, tfs, runs, run_tfs): each document's distinct tokens and how often it has them.

    ``runs`` are those without pairs of Han signs, null where they are the tokens. A text is folded,
    split and counted in one pass, so what leaves Python is a third of its tokens.
    A null text has none. A few files are dealt out to all cores first.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts, numbers = pa.list_(pa.string()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.slice(at, 256), []
                for x in part.column(1):
                    found = tokens_of(x.as_py() or "", pairs=False)
                    runs = Counter(found)
                    counts = Counter(paired(found)) if any(map(_HAN.match, runs)) else runs
                    rows.append((counts.total(), list(counts), list(counts.values()), *((None, None) if counts is runs else (list(runs), list(runs.values())))))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), texts, numbers, texts, numbers), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, "length", "tokens", "tfs", "runs", "run_tfs"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, length long, tokens array<string>, tfs array<int>, runs array<string>, run_tfs array<int>")


def exploded(counts: DataFrame, key: str, runs: bool = False) -> DataFrame:
    """(key, length, token, tf) of :func:`counted` documents, a row a document and token."""
    names = (F.coalesce("runs", "tokens"), F.coalesce("run_tfs", "tfs")) if runs else (F.col("tokens"), F.col("tfs"))
    both = F.explode(F.arrays_zip(names[0].alias("token"), names[1].alias("tf"))).alias("p")
    return counts.select(key, "length", both).select(key, "length", F.col("p.token").alias("token"), F.col("p.tf").alias("tf"))


def weight(tf: Column, length: Column, mean: float) -> Column:
    """What a posting adds to a score, but for the token's rarity."""
    return (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / F.lit(mean if mean > 0 else 1.0)))


def saturated(mean: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """:func:`weight` of arrays of counts and lengths."""
    return lambda tf, length: (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / (mean if mean > 0 else 1.0)))


def rarity(n_docs: int, df: Column) -> Column:
    return F.log1p((F.lit(n_docs) - df + 0.5) / (df + 0.5))


def _best_of_block(k: int, doc: str, query: str, worth: Callable[[np.ndarray, np.ndarray], np.ndarray], schema: pa.Schema):
    """The best ``k`` documents of a block for each query of a part, from the documents' counted tokens."""

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(stored) or not len(asked):
            return schema.empty_table()
        words = asked["token"].unique()
        of = pc.index_in(asked["token"], words).to_numpy()
        coded = asked[query].combine_chunks().dictionary_encode("encode")
        order = np.argsort(of, kind="stable")
        asks, share, n_asks = coded.indices.to_numpy()[order], asked["worth"].to_numpy()[order], len(coded.dictionary)
        start = np.searchsorted(of[order], np.arange(len(words) + 1))
        stored = stored.take(pc.array_sort_indices(stored[doc], null_placement="at_start"))
        keys = stored[doc].combine_chunks().dictionary_encode("encode")  # in order, so a row's number breaks ties
        sizes = pc.list_value_length(stored["tokens"]).to_numpy()
        found = pc.fill_null(pc.index_in(pc.list_flatten(stored["tokens"]), words), -1).to_numpy()
        met = found >= 0
        own = np.repeat(np.arange(len(stored)), sizes)[met]
        row, found, tf = keys.indices.to_numpy()[own], found[met], pc.list_flatten(stored["tfs"]).to_numpy()[met]
        value, n = worth(tf.astype(np.float64), stored["length"].to_numpy()[own]), start[found + 1] - start[found]
        pairs = np.concatenate([[0], np.cumsum(np.bincount(row, n, len(keys.dictionary)))])
        best, rows, low = np.zeros((0, n_asks)), np.zeros((0, n_asks), np.int64), 0
        while low < len(keys.dictionary):  # few rows at a time: their scores are a dense table
            high = max(low + 1, min(low + max(1, CELLS // n_asks), int(np.searchsorted(pairs, pairs[low] + CELLS, "right")) - 1))
            at = slice(*np.searchsorted(row, [low, high]))
            m = n[at]
            place = np.repeat(start[found[at]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            score = np.bincount(np.repeat(row[at] - low, m) * n_asks + asks[place], np.repeat(value[at], m) * share[place], (high - low) * n_asks)
            best = np.vstack([best, np.floor(score.reshape(-1, n_asks) * 1e6 + 0.5) / 1e6])
            rows = np.vstack([rows, np.broadcast_to(np.arange(low, high)[:, None], (high - low, n_asks))])
            first = np.argsort(-best, axis=0, kind="stable")[:k]
            best, rows, low = np.take_along_axis(best, first, 0), np.take_along_axis(rows, first, 0), high
        a, b = np.nonzero(best > 0)
        return pa.Table.from_arrays([coded.dictionary.take(pa.array(b)), keys.dictionary.take(pa.array(rows[a, b])), pa.array(best[a, b])], schema=schema)

    return run


def best_by_blocks(counts: DataFrame, asked: DataFrame, doc: str, query: str, k: int, worth: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Best ``k`` of ``counts`` (doc, length, tokens, tfs) for every query of ``asked`` (query, token, worth, read from files): (query, doc, score, rank).

    A posting adds ``worth`` of its count and its document's length, times that of the token asked for; scores of 0 are none.
    Blocks of documents meet parts of the queries, and only a block's best leave it, so no row a query and document is made. Counts are moved
    once a part, queries once a block.
    """
    size, n_asks = counts.agg(F.sum(F.size("tokens"))).first()[0] or 0, asked.select(query).distinct().count()
    blocks, parts = -(-size // POSTINGS) or 1, -(-n_asks // PART) or 1
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = counts.select(hashed(doc, blocks).alias("block"), every(parts).alias("part"), doc, "length", "tokens", "tfs")
    right = asked.select(every(blocks).alias("block"), hashed(query, parts).alias("part"), query, "token", "worth")
    kind = StructType([asked.schema[query], counts.schema[doc], StructField("score", DoubleType())])
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_best_of_block(k, doc, query, worth, to_arrow_schema(kind)), kind)
    return top_per_key(found, [query], [F.desc("score"), F.col(doc)], k)


class SearchIndex:
    """The index in the folder ``path`` over documents told apart by the column ``key`` (an integer or a string)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.segments = VersionedTable(spark, f"{self.path}/segments", "segment")

    # -- writing

    def add(self, docs: DataFrame, text: str = "text") -> str | None:
        """Add ``docs`` as a segment; their keys must be new and not null. An empty table adds none. Returns the segment's name."""
        base, name = self.segments.version(), uuid.uuid4().hex
        where = f"{self.path}/parts/{name}"
        counted(docs, self.key, text).drop("runs", "run_tfs").write.parquet(f"{where}/docs")
        rows = self.spark.read.parquet(f"{where}/docs")
        keys = rows.select(self.key)
        if twice := keys.groupBy(self.key).count().where((F.col("count") > 1) | F.col(self.key).isNull()).take(1):
            raise ValueError(f"{self.key} {twice[0][0]} is null or not one document's")
        there = self._read("docs")
        if there is not None and (known := keys.join(there.select(self.key), self.key, "left_semi").take(1)):
            raise ValueError(f"{self.key} {known[0][0]} is in the index")
        return self._finish(base, name, rows, replace=False)

    def merge(self) -> str | None:
        """Write all segments anew as one, with weights by the mean of now. No text is read."""
        base = self.segments.version()
        rows = self._read("docs")
        if rows is None:
            return None
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{name}/docs")
        return self._finish(base, name, self.spark.read.parquet(f"{self.path}/parts/{name}/docs"), replace=True)

    def _finish(self, base, name: str, rows: DataFrame, replace: bool) -> str | None:
        totals = rows.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.size("tokens"))).first()
        n_docs, total, n_postings = totals[0], totals[1] or 0, totals[2] or 0
        if not n_docs:
            return None
        mean = total / n_docs
        postings = exploded(rows, self.key)
        counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        frequent = counts.where(F.col("df") > max(BLOCK, n_postings // FREQUENT)).select("token", F.ceil(F.col("df") / BLOCK).cast("int").alias("pieces"))
        part = weight(F.col("tf"), F.col("length"), mean)
        level = F.ceil(part * (LEVELS / (K1 + 1.0))).cast("int")
        placed = postings.withColumn("level", level).join(F.broadcast(frequent), "token", "left")
        piece = F.pmod(F.xxhash64(self.key, F.lit(3)), F.coalesce("pieces", F.lit(1))).cast("int")
        shard = F.pmod(F.xxhash64(self.key, F.lit(5)), F.lit(-(-n_docs // SHARD))).cast("int")
        rows_of = F.collect_list(F.struct(F.col(self.key).alias("doc"), "tf", "length"))
        blocks = placed.groupBy("token", "level", shard.alias("shard"), piece.alias("piece")).agg(rows_of.alias("postings"))
        top = F.array_max(F.transform("postings", lambda p: weight(p["tf"], p["length"], mean)))  # of the whole block: postings are moved without their weights
        blocks = blocks.select("token", "level", "shard", "piece", top.alias("top"), F.size("postings").cast("long").alias("n"), "postings")
        blocks.sortWithinPartitions("token", F.desc("level")).write.parquet(f"{self.path}/parts/{name}/blocks")
        entry = self.spark.createDataFrame([(name, n_docs, total, n_postings)], "segment string, n_docs long, total long, n_postings long")
        if replace:
            self.segments.replace(entry, [*base.files, name], base)
        else:
            self.segments.append(entry, base)
        return name

    # -- reading

    def _listed(self) -> list:
        table = self.segments.read()
        return table.collect() if table is not None else []  # a row a segment

    def _read(self, kind: str) -> DataFrame | None:
        names = [r["segment"] for r in self._listed()]
        return self.spark.read.parquet(*(f"{self.path}/parts/{n}/{kind}" for n in names)) if names else None

    def figures(self) -> tuple[int, float, int]:
        """Documents, mean length and postings of the index."""
        listed = self._listed()
        n, total = sum(r["n_docs"] for r in listed), sum(r["total"] for r in listed)
        return n, (total / n if n else 0.0), sum(r["n_postings"] for r in listed)

    def damage(self) -> DataFrame:
        """(segment, part): parts whose counts aren't those that were noted when the segment was written. Reads columns of counts only."""
        rows = []
        for r in self._listed():  # a row a segment
            where = f"{self.path}/parts/{r['segment']}"
            docs = self.spark.read.parquet(f"{where}/docs").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            blocks = self.spark.read.parquet(f"{where}/blocks").agg(F.coalesce(F.sum("n"), F.lit(0))).first()
            rows += [(r["segment"], "docs")] * (tuple(docs) != (r["n_docs"], r["total"])) + [(r["segment"], "blocks")] * (blocks[0] != r["n_postings"])
        return self.spark.createDataFrame(rows, "segment string, part string")

    def _heads(self, asked: DataFrame) -> DataFrame:
        """segment, token, level, shard, piece, n, bound of the blocks of the tokens asked for; bound lacks the token's rarity."""
        _, mean, _ = self.figures()
        own, wanted = F.col("total") / F.col("n_docs"), asked.select("token").distinct()
        grown = F.when(own > 0, F.greatest(F.lit(1.0), F.lit(mean) / own)).otherwise(1.0)
        heads = self._blocks().drop("postings").join(F.broadcast(self.segments.read().select("segment", grown.alias("grown"))), "segment")  # a row a segment
        return heads.withColumn("bound", F.col("top") * F.col("grown")).drop("top", "grown").join(wanted, "token", "left_semi")

    def _blocks(self) -> DataFrame:
        out = None
        for r in self._listed():
            part = self.spark.read.parquet(f"{self.path}/parts/{r['segment']}/blocks").select(F.lit(r["segment"]).alias("segment"), "*")
            out = part if out is None else out.unionByName(part)
        return out

    def _probed(self, steps: DataFrame, heads: DataFrame, query: str, most: int) -> DataFrame:
        """(query, doc) of about ``most`` postings of each level in ``steps`` (query, token, level): a level may hold a share of all documents."""
        levels = steps.select("token", "level").distinct()
        order = Window.partitionBy("token", "level").orderBy("segment", "shard", "piece").rowsBetween(Window.unboundedPreceding, -1)
        few = heads.join(levels, ["token", "level"], "left_semi").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < most)
        some = self._blocks().join(cut(few.select("segment", "token", "level", "shard", "piece"), "probed"), ["segment", "token", "level", "shard", "piece"], "left_semi")
        docs = some.select("token", "level", F.explode(F.transform(F.slice("postings", 1, most), lambda p: p["doc"])).alias(self.key))
        return docs.join(steps.select(query, "token", "level"), ["token", "level"]).select(query, self.key).distinct()

    def _opened(self, steps: DataFrame, asked_key: str) -> DataFrame:
        """(query, doc, token, tf, length) of the postings in the levels that ``steps`` (query, token, level) opens."""
        blocks = self._read("blocks").select("token", "level", "postings")
        met = blocks.join(steps.select(asked_key, "token", "level"), ["token", "level"])
        return met.select(asked_key, "token", F.explode("postings").alias("p")).select(asked_key, "token", "p.*")

    def search(self, queries: DataFrame, query: str, text: str = "text", k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Best ``k`` documents of every query, (query, doc key, score, rank), and (query, opened, scored, postings).

        The same rows as of :func:`retrieval.bm25`. The second table says how many of the query's tokens' ``postings`` were opened,
        and how many entries of counted documents were read to score the rest.
        """
        key = self.key
        schema = self.spark.createDataFrame([], f"`{query}` {queries.schema[query].dataType.simpleString()}")
        n_docs, mean, _ = self.figures()
        if not n_docs:
            none = schema.select(query, F.lit(None).cast("long").alias(key), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
            return none, schema.select(query, *(F.lit(0).cast("long").alias(c) for c in ("opened", "scored", "postings")))
        asked = counted(queries, query, text).select(query, F.explode("tokens").alias("token")).distinct()
        heads = cut(self._heads(asked), "heads")
        df = heads.groupBy("token").agg(F.sum("n").alias("df"))
        asked = cut(asked.join(df, "token").withColumn("idf", rarity(n_docs, F.col("df"))), "asked")
        steps = heads.groupBy("token", "level").agg(F.sum("n").alias("n"), F.max("bound").alias("bound"))
        steps = asked.join(steps, "token").withColumn("bound", F.col("bound") * F.col("idf"))
        down = Window.partitionBy(query, "token").orderBy(F.desc("level"))
        steps = steps.withColumn("gain", F.col("bound") - F.coalesce(F.lead("bound").over(down), F.lit(0.0)))
        # a level is opened after those above it, however little they bring
        steps = steps.withColumn("worth", F.min(F.col("gain") / F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        order = Window.partitionBy(query).orderBy(F.desc("worth"), "token", F.desc("level"))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("spent", F.coalesce(F.sum("n").over(before), F.lit(0)))
        steps = cut(steps.withColumn("left", F.sum("gain").over(Window.partitionBy(query)) - F.coalesce(F.sum("gain").over(before), F.lit(0.0))), "steps")

        exact = self._exact(asked, query, mean)
        first = cut(self._probed(steps.where(F.col("spent") < PROBE * k), heads, query, PROBE * k), "first")
        kth = top_per_key(exact(first), [query], [F.desc("score"), F.col(key)], k).groupBy(query).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        least = cut(kth.select(query, F.when(F.col("n") >= k, F.col("least") - _SLACK).otherwise(0.0).alias("least")), "least")

        opened = steps.join(least, query, "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        opened = cut(opened.withColumn("open", (F.col("left") >= F.col("least")) | (F.col("least") <= 0)), "opened")
        # a query that would open a posting of many documents scans all of them, with the others like it
        per = opened.groupBy(query).agg(F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("opened"), F.sum("n").alias("postings"))
        per = cut(per.withColumn("wide", F.col("opened") > n_docs // SCAN), "per")
        opened = opened.join(per.where("NOT wide"), query, "left_semi")
        # what closed levels could add: per token the greatest closed one, and of all tokens of the query
        closed = opened.where("NOT open").groupBy(query, "token").agg(F.max("bound").alias("closed"))
        rest = closed.groupBy(query).agg(F.sum("closed").alias("rest"))
        found = self._opened(opened.where("open"), query).join(asked.select(query, "token", "idf"), [query, "token"]).join(closed, [query, "token"], "left")
        sums = found.groupBy(query, F.col("doc").alias(key)).agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("length"), mean) - F.coalesce("closed", F.lit(0.0))).alias("sum"))
        able = sums.join(rest, query, "left").join(least, query, "left").where(F.col("sum") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0)))
        able = cut(able.select(query, key), "able")
        # so does a query of which too many documents are left to read their tokens
        mean_tokens = self.figures()[2] / n_docs
        per = per.join(able.groupBy(query).agg(F.count(F.lit(1)).alias("able")), query, "left").withColumn("able", F.coalesce("able", F.lit(0)))
        per = cut(per.withColumn("whole", F.col("wide") | (F.col("able") * mean_tokens > F.col("postings") - F.col("opened"))), "per")
        few, many = (per.where(when).select(query) for when in ("NOT whole", "whole"))
        best = top_per_key(exact(able.join(few, query, "left_semi")).where("score > 0"), [query], [F.desc("score"), F.col(key)], k)
        whole = cut(asked.join(many, query, "left_semi").select(query, "token", F.col("idf").alias("worth")), "whole")
        if not whole.isEmpty():
            best = best.unionByName(best_by_blocks(self._read("docs"), whole, key, query, k, saturated(mean)))

        entries = able.join(few, query, "left_semi").join(self._read("docs").select(key, F.size("tokens").alias("n")), key).groupBy(query).agg(F.sum("n").alias("scored"))
        report = per.join(entries, query, "left").select(query, F.when(F.col("whole"), F.col("postings")).otherwise(F.col("opened")).alias("opened"), F.coalesce("scored", F.lit(0)).cast("long").alias("scored"), "postings")
        return best, report

    def _exact(self, asked: DataFrame, query: str, mean: float):
        """A function that scores pairs of query and document from the documents' own counted tokens."""
        listed = asked.groupBy(query).agg(F.collect_set("token").alias("wanted"))

        def score(pairs: DataFrame) -> DataFrame:
            own = pairs.join(listed, query).join(self._read("docs"), self.key)
            met = own.select(query, self.key, "length", F.explode(F.filter(F.arrays_zip("tokens", "tfs"), lambda x: F.array_contains("wanted", x["tokens"]))).alias("p"))
            parts = met.select(query, self.key, "length", F.col("p.tokens").alias("token"), F.col("p.tfs").alias("tf")).join(asked.select(query, "token", "idf"), [query, "token"])
            return parts.groupBy(query, self.key).agg(F.round(F.sum(F.col("idf") * weight(F.col("tf"), F.col("length"), mean)), 6).alias("score"))

        return score

"""MinHash near-dedup with sequential Bayesian verification.

A text's set is its distinct shingles. Sets are sketched by 8-bit MinHashes; rows of
seven make a band, and texts that share a band are candidates. A candidate
pair's sketches are compared batch by batch: after each batch the posterior
probability that the similarity reaches the threshold (uniform prior, binomial
likelihood, corrected for chance agreement of 8 bits) must stay above the chosen
miss probability, else the pair goes. What survives is verified on the full sets.

Groups of copies never become all pairs: equal sets are one class. In a bucket, each
class meets one member drawn by the bucket's key; classes that this joins are one component,
and only pairs of different components that share a bucket are looked at further, in
bounded blocks, all of them. Similarity joins that would change no component
are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, cut, drop, grid, sliced, small_batches

ROWS = 7  # hashes of a band; a band's seven bytes and its number fit one long
BANDS = 48
HASHES = ROWS * BANDS
BATCH = 48  # hashes compared between two looks at the posterior
MISS = 1e-6  # posterior probability below which a candidate pair is given up
_MEMO = 200_000  # words whose hash a worker keeps: about 40 MB
_WIDE = 4096  # shingles hashed at a time


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    a = draw.integers(0, 2**31, HASHES, dtype=np.int64) * 2 + 1
    b = draw.integers(0, 2**32, HASHES, dtype=np.int64)
    return a.astype(np.uint32)[:, None], b.astype(np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes split and fold ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """Distinct ``k``-word shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _hashed(words: list[bytes], k: int, memo: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    take = min(k, len(h))
    if not take:
        return h
    n = len(h) - take + 1
    x = np.full(n, take, np.uint64)
    for i in range(take):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(x)


def _sketch(x: np.ndarray) -> bytes:
    a, b = _permutations()
    low = (x >> np.uint64(32)).astype(np.uint32)
    least = (low[:_WIDE] * a + b).min(axis=1)
    for i in range(_WIDE, len(low), _WIDE):
        least = np.minimum(least, (low[i : i + _WIDE] * a + b).min(axis=1))
    return least.astype(np.uint8).tobytes()


_SKETCH = "doc_id long, n_shingles long, hi long, lo long, sketch binary"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sketch) a row of ``docs``; hi and lo: 128 bits of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in sliced(batches, 1):
            n, hi, lo, sketch = [], [], [], []
            for text in batch.column(1):
                x = _hashed(words_of(text.as_py()), k, memo)
                both = xxhash.xxh3_128_intdigest(x.tobytes())
                n.append(len(x))
                hi.append((both >> 64) - 2**63 if len(x) else None)
                lo.append((both & 2**64 - 1) - 2**63 if len(x) else None)
                sketch.append(_sketch(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "hi", "lo", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), HASHES)


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each class and band; the key is the band's number and its seven bytes."""
    for part in batches:
        if len(part):
            octets = np.zeros((len(part), BANDS, 8), np.uint8)
            octets[:, :, :ROWS] = _matrix(part["sketch"]).reshape(len(part), BANDS, ROWS)
            octets[:, :, ROWS] = np.arange(BANDS)
            yield pd.DataFrame({"key": octets.reshape(-1).view(np.int64), "class_id": np.repeat(part["class_id"].to_numpy(), BANDS)})


def agreement(similarity: float) -> float:
    """Probability that two 8-bit MinHashes agree."""
    return similarity + (1 - similarity) / 256


@lru_cache(16)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """Fewest agreements after each batch with P(similarity >= threshold | agreements) >= miss.

    With a uniform prior that posterior is P(Bin(n + 1, t) <= agreements), t being
    the agreement at the threshold.
    """
    t, out = agreement(threshold), []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that no batch rules out, and their agreements."""
    at, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for i, least in enumerate(least_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (left[at, part] == right[at, part]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        at, matches = at[keep], matches[keep]
    return at, matches


def _near_size(percent: int) -> str:
    """Size bound: sets of which one is much smaller can't reach the similarity."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _bayes(pairs: DataFrame, reps: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that size bound and posterior leave, with their agreements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                at, matches = surviving(_matrix(part["sa"]), _matrix(part["sb"]), percent / 100, miss)
                yield pd.DataFrame({"a": part["a"].to_numpy()[at], "b": part["b"].to_numpy()[at], "matches": matches})

    left = reps.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_near_size(percent)).select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, matches int")


def _exact(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (src, dst) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, set] = {}
        for part in batches:
            ok = []
            for a, b, ta, tb in zip(part["a"], part["b"], part["ta"], part["tb"], strict=True):
                if len(kept) > 256:
                    kept.clear()
                x = kept[a] if a in kept else kept.setdefault(a, shingle_set(ta, k))
                y = kept[b] if b in kept else kept.setdefault(b, shingle_set(tb, k))
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.array(ok, bool)
            yield pd.DataFrame({"src": part["a"].to_numpy()[keep], "dst": part["b"].to_numpy()[keep]})

    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "src long, dst long")


def _with_component(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    mine = labels.select(F.col("id").alias(column), F.col("component_id").alias(name))
    return df.join(mine, column, "left").withColumn(name, F.coalesce(name, column))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that these join are walked again."""
    ends = _with_component(_with_component(links, labels, "src", "cs"), labels, "dst", "cd")
    ends = cut(ends.select("src", "dst", "cs", "cd"), "ends")
    up = components(ends.select(F.col("cs").alias("src"), F.col("cd").alias("dst")).where("src <> dst").distinct())
    fresh = ends.select(F.col("src").alias("id")).union(ends.select("dst")).distinct().join(labels, "id", "left_anti")
    every = labels.select("id", F.col("component_id").alias("c")).union(fresh.select("id", F.col("id").alias("c")))
    moved = every.join(up.select(F.col("id").alias("c"), "component_id"), "c", "left")
    return cut(moved.select("id", F.coalesce("component_id", "c").alias("component_id")), "labels")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    return _with_component(_with_component(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")


def _sets(k: int):
    """(class_id, members): 32 bits of the hash of each shingle, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for part in batches:
            found = [np.unique((_hashed(words_of(t), k, memo) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in part["text"]]
            yield pd.DataFrame({"class_id": part["doc_id"], "members": found})

    return run


def _blocks(percent: int, miss: float):
    """Pairs of different components within a block that share this band first, survive, and whose hashed sets are near enough.

    Two shingles with equal 32 bits can lower a count by one; the bound allows for it, and
    the full sets decide afterwards.
    """

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (key, lo, hi), block in cell.groupby(["key", "lo", "hi"], sort=False):
            ids, comp, n = (block[c].to_numpy() for c in ("class_id", "comp", "n_shingles"))
            sketch, chunk = _matrix(block["sketch"]), block["chunk"].to_numpy()
            sets = [np.frombuffer(x, np.uint32) for x in block["members"]]
            values, counts = np.unique(comp, return_counts=True)
            rest, band = comp != values[counts.argmax()], (int(key) >> 56) & 0xFF
            for i in np.flatnonzero(rest):
                apart = comp != comp[i]
                if lo != hi:
                    apart &= chunk != chunk[i]
                apart &= ~rest | (ids > ids[i])
                apart &= percent * np.maximum(n, n[i]) <= 100 * np.minimum(n, n[i])
                j = np.flatnonzero(apart)
                if not len(j):
                    continue
                alike = (sketch[j] == sketch[i]).reshape(len(j), BANDS, ROWS).all(axis=2)
                j = j[alike.argmax(axis=1) == band]
                j = j[surviving(np.broadcast_to(sketch[i], (len(j), HASHES)), sketch[j], percent / 100, miss)[0]]
                if not len(j):
                    continue
                size = np.array([len(sets[x]) for x in j])
                others = np.concatenate([sets[x] for x in j])
                at = np.minimum(np.searchsorted(sets[i], others), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][at] == others).astype(np.int64), np.cumsum(size) - size)
                near = 100 * (both + 1) >= percent * (size + len(sets[i]) - both)
                out += [(min(ids[i], x), max(ids[i], x)) for x in ids[j[near]]]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked at 100 * intersection >= ``percent`` * union of their
    ``k``-word shingle sets. component_id is the smallest doc_id reachable,
    itself included; kept says that it is the row's own. Null, empty and white texts have
    no shingle and link with nothing. A text of fewer words than ``k`` is one
    shingle. Rows that repeat a doc_id are one document of several texts: each
    returns its own row and they share a component. Rows without doc_id take no
    part: component_id is null and they are kept. An empty table gives an empty
    result. Columns other than doc_id and text are not read.

    Candidates share one of 48 bands of 7 hashes: a pair at similarity 0.8 is
    missed with probability 1.2e-5, at 0.85 with 6e-9.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not _repeats(rows):
        return _near(rows, k, percent, miss)
    # ids that repeat: rows get ids of their own, and a document's rows are tied together afterwards
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    own = rows.where("doc_id is not null")
    found = cut(_near(own.select(F.col("row").alias("doc_id"), "text"), k, percent, miss).distinct(), "rows")
    tied = own.join(found.select(F.col("doc_id").alias("row"), "n_shingles", "component_id"), "row").select("doc_id", "n_shingles", F.xxhash64("component_id", F.lit("rows")).alias("c"))
    tied = cut(tied, "tied")
    labels = components(tied.select(F.col("c").alias("src"), F.xxhash64("doc_id", F.lit("ids")).alias("dst")).distinct())
    whole = tied.join(labels.select(F.col("id").alias("c"), F.col("component_id").alias("label")), "c")
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    given = whole.join(least, "label").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return given.union(_near(rows.where("doc_id is null").select("doc_id", "text"), k, percent, miss))


def _near(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """:func:`near_duplicates` of rows (doc_id, text) whose ids don't repeat."""
    all_rows = cut(sketches(docs, k), "sketches")
    classes = cut(all_rows.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id")), "classes")
    first = classes.select("class_id").where("class_id is not null")
    reps = cut(
        all_rows.join(first.withColumnRenamed("class_id", "doc_id"), "doc_id", "left_semi")
        .join(classes, ["hi", "lo"])
        .where("doc_id = class_id")
        .select("class_id", "n_shingles", "sketch"),
        "reps",
    )
    banded = reps.select("class_id", "sketch").mapInPandas(_banded, "key long, class_id long")
    mask = F.xxhash64("key")
    hubs = (
        banded.groupBy("key").agg(F.min(F.col("class_id").bitwiseXOR(mask)).alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", F.col("least").bitwiseXOR(mask).alias("hub"))
    )
    shared = cut(banded.join(hubs, "key"), "shared")
    pairs = shared.where("class_id <> hub").select(F.least("class_id", "hub").alias("a"), F.greatest("class_id", "hub").alias("b")).distinct()
    likely = cut(_bayes(pairs, reps, percent, miss), "likely")

    wanted = shared.select(F.col("class_id").alias("doc_id")).distinct()
    texts = cut(docs.join(wanted, "doc_id", "left_semi"), "texts")

    # each class's most alike partner first: most of the other pairs then join nothing new
    ends = likely.select(F.col("a").alias("id"), "a", "b", "matches").union(likely.select(F.col("b").alias("id"), "a", "b", "matches"))
    best = ends.groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("matches", F.col("a") + F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    links = cut(_exact(best, texts, k, percent), "links")
    labels = components(links)
    across = cut(_across(likely, labels).join(best, ["a", "b"], "left_anti"), "across")
    lead = across.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max_by(F.struct("a", "b"), F.struct("matches", "a", "b")).alias("p")).select("p.a", "p.b")
    labels = _joined(labels, _exact(lead, texts, k, percent))
    labels = _joined(labels, _exact(_across(across.select("a", "b"), labels), texts, k, percent))

    # every other pair of different components that shares a band, block by block
    member = _with_component(shared.select("key", "class_id"), labels, "class_id", "comp")
    mixed = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    opened = cut(member.join(mixed, "key"), "open")
    sets = texts.join(opened.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInPandas(_sets(k), "class_id long, members binary")
    cells = grid(opened, "key", "class_id", 1024, 20_000).join(reps.join(sets, "class_id"), "class_id")
    cells = cells.select("key", "class_id", "comp", "n_shingles", "sketch", "members", "chunk", "lo", "hi", "cell")
    late = cut(cells.groupBy("cell").applyInPandas(_blocks(percent, miss), "a long, b long").distinct().join(likely, ["a", "b"], "left_anti"), "late")
    labels = _joined(labels, _exact(late, texts, k, percent))
    for table in (shared, texts, opened, likely, across, late, reps):
        drop(table)

    component = _with_component(classes.where("class_id is not null"), labels, "class_id", "component_id")
    return (
        all_rows.select("doc_id", "n_shingles", "hi", "lo")
        .join(component.select("hi", "lo", "component_id"), ["hi", "lo"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _repeats(rows: DataFrame) -> bool:
    return not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of smallest doc_id.

    Columns stay as they are. Rows without doc_id stay, as nothing says which
    document they repeat; of rows that repeat a doc_id that whose text has the smallest digest stays, the same at every run.
    """
    found = near_duplicates(docs, k, percent)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    if not _repeats(docs):
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    row = F.struct(*docs.columns)
    first = F.struct(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.to_json(row))
    one = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(row, first).alias("_row"))
    return docs.where("doc_id is null").union(one.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))

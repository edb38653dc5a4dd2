"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample and split until their lists are balanced. Each
vector goes to the list of its nearest centroid and, when it lies near a boundary, to
more. A query finds near centroids through an in-memory graph of centroids and reads
the lists whose distance is within a ratio of the nearest. How near a boundary is and how
far a query reads are fitted too: on the sample, to the recall asked for at the least reading.

Lists that lie close together are searched as one cell, heavy cells in parts. The cell of a
query's nearest list goes first; what is found there bounds its other cells, which
return nothing below.

Largest inner product becomes nearest vector by one more component: sqrt(M^2 - |x|^2)
for stored vectors, M being the greatest norm, and 0 for queries, which are stretched to norm M.
For this vectors are divided by the largest component of all, so that nothing overflows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut
from siltstone.llm.vectors import dimension, dots, matrix, usable

SAMPLE = 20_000  # vectors that centroids and ratios are fitted on, at most
LIST = 32  # vectors whose nearest centroid is the same, as a mean, as far as the sample allows so many centroids
COPIES = 8  # lists of a boundary vector at most
CLOSE = (1.0, 1.03, 1.08, 1.2)  # ratios tried: a vector also goes to lists within this ratio of its nearest centroid's distance
OPENING = 256  # vectors that reading a list costs as much as, besides its own
RECALL = 0.96  # of the sample's true neighbours whose lists are to be read
ASKED = 256  # vectors of the sample that the ratios are tried with
NEAR = 8  # nearest centroids whose mean distance a query's ratio starts from: a single one's says little
NEIGHBOURS = 24  # of a centroid in the graph
WIDTH = 8  # centroids that a step of the walk opens
CELL = 64  # lists of a cell, as a mean
PART = 16_384  # rows of a cell that one block takes
QUERIES = 4_096  # queries that one block takes


def centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Means of ``k`` balanced clusters of ``x``: the largest cluster is halved until there are ``k``."""
    draw = np.random.default_rng(seed)
    clusters = [np.arange(len(x))]
    while len(clusters) < k:
        clusters.sort(key=len)
        own = clusters.pop()
        if len(own) < 2:
            clusters.append(own)
            break
        points = x[own]
        mean = points[draw.choice(len(own), 2, replace=False)]
        for _ in range(6):
            # halves by the difference of distances: both sides stay equally large
            gap = ((points - mean[0]) ** 2).sum(axis=1) - ((points - mean[1]) ** 2).sum(axis=1)
            side = np.argsort(np.argsort(gap, kind="stable")) >= len(own) // 2
            mean = np.stack([points[~side].mean(axis=0), points[side].mean(axis=0)])
        clusters += [own[~side], own[side]]
    return np.stack([x[c].mean(axis=0) for c in clusters])


class Graph:
    """Neighbour graph of the centroids; a search walks it from entry points, best first.

    What a walk has met is its beam alone: ids and distances of the nearest so far.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.square = points, (points**2).sum(axis=1)
        k = min(NEIGHBOURS, len(points) - 1)
        near = np.zeros((len(points), k), np.int64)
        for at in range(0, len(points), 512):
            far = self.square[None] - 2 * points[at : at + 512] @ points.T
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            near[at : at + 512] = np.argsort(far, axis=1, kind="stable")[:, :k]
        # long links: tight groups of centroids would else know each other alone
        draw = np.random.default_rng(4)
        self.links = np.hstack([near, draw.integers(0, len(points), (len(points), min(8, k)))])
        self.entry = np.unique(np.linspace(0, len(points) - 1, min(32, len(points))).astype(np.int64))

    def search(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest ``wanted`` centroids of each row and their distances, nearest first, as far as the walk meets them."""
        n, k = len(x), len(self.points)
        wanted = min(wanted, k)
        beam = min(k, max(wanted + WIDTH, 40))
        norm = (x**2).sum(axis=1)

        def merged(rows: np.ndarray, met: np.ndarray, ids: np.ndarray, far: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The beams of ``rows`` with centroids ``met`` added, nearest first, each centroid once."""
            new = self.square[met] - 2 * np.einsum("rd,rmd->rm", x[rows], self.points[met])
            ids, far, done = np.hstack([ids, met]), np.hstack([far, new]), np.hstack([done, np.zeros(met.shape, bool)])
            order = np.lexsort((~done, ids), axis=1)  # opened copies first, so that a centroid opens once
            ids, far, done = (np.take_along_axis(t, order, 1) for t in (ids, far, done))
            far[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            return tuple(np.take_along_axis(t, order, 1) for t in (ids, far, done))

        rows = np.arange(n)
        empty = np.zeros((n, 0))
        ids, far, done = merged(rows, np.tile(self.entry, (n, 1)), empty.astype(np.int64), empty, empty.astype(bool))
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids, far, done = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(far, ((0, 0), (0, pad)), constant_values=np.inf), np.pad(done, ((0, 0), (0, pad)), constant_values=True)
        while len(rows) and self.links.shape[1]:
            waiting = np.where(done[rows] | np.isinf(far[rows]), np.inf, far[rows])
            at = np.argsort(waiting, axis=1, kind="stable")[:, :WIDTH]
            going = np.isfinite(np.take_along_axis(waiting, at, 1))
            keep = going.any(axis=1)
            rows, at, going = rows[keep], at[keep], going[keep]
            if not len(rows):
                break
            opened = np.take_along_axis(ids[rows], at, 1)
            opened = np.where(going, opened, opened[:, :1])
            mark = done[rows]
            np.put_along_axis(mark, np.where(going, at, at[:, :1]), True, 1)
            met = self.links[opened].reshape(len(rows), -1)
            ids[rows], far[rows], done[rows] = merged(rows, met, ids[rows], far[rows], mark)
        return ids[:, :wanted], np.sqrt(np.maximum(far[:, :wanted] + norm[:, None], 0))


class Index(NamedTuple):
    """What was fitted on the sample: all that a task needs to place vectors and to choose lists."""

    graph: Graph
    close: float  # a vector also goes to lists within this ratio
    ratio: float  # a query reads lists within this ratio of the mean distance of its nearest ones
    floor: float  # nearest distances count as this at least, so that a ratio says something where they vanish
    cells: np.ndarray  # cell of each list
    unit: float  # vectors are divided by this
    most: float  # greatest norm after that
    recall: float  # share of the sample's true neighbours whose lists are read
    share: float  # share of the lists that a query reads, as the mean over the sample
    copies: float  # lists of a vector, as the mean over the sample

    def stored(self, v: np.ndarray) -> np.ndarray:
        x = v / self.unit
        return np.hstack([x, np.sqrt(np.maximum(self.most**2 - (x**2).sum(axis=1), 0))[:, None]])

    def asked(self, v: np.ndarray) -> np.ndarray:
        x = v / np.abs(v).max(axis=1, keepdims=True)
        x *= self.most / np.sqrt((x**2).sum(axis=1, keepdims=True))
        return np.hstack([x, np.zeros((len(x), 1))])

    def reach(self, far: np.ndarray, ratio: float, near: int = 1) -> np.ndarray:
        """Distances up to which lists count, ``far`` being those found, nearest first."""
        return ratio * np.maximum(far[:, :near].mean(axis=1, keepdims=True), self.floor) + 1e-12


def fitted(sample: np.ndarray, rows: int, unit: float, most: float, top: int) -> Index:
    """Centroids and ratios from a ``sample`` of ``rows`` vectors.

    For each ratio of ``CLOSE`` the sample is placed, and the reading ratio is the one that covers ``RECALL`` of
    the true neighbours of ``ASKED`` of its vectors. The pair that costs least is taken, a list
    counting as OPENING vectors more. Neighbours in the sample are farther than those among all rows, so that is on the safe side.
    """
    one = Index(Graph(np.zeros((1, sample.shape[1] + 1))), 1.0, np.inf, 0.0, np.zeros(1, np.int64), unit, most, 1.0, 1.0, 1.0)
    points = one.stored(sample)
    k = int(max(1, min(rows // LIST, len(sample) // 4)))
    if k == 1:
        return one._replace(graph=Graph(points.mean(axis=0, keepdims=True)))
    # those that ask are no part of the centroids: they would lie nearer to their own than others do
    asks = np.unique(np.linspace(0, len(points) - 1, min(ASKED, len(points) // 4)).astype(np.int64))
    graph = Graph(centroids(np.delete(points, asks, axis=0), k))
    k = len(graph.points)
    lists, far = (np.concatenate(t) for t in zip(*(graph.search(points[i : i + 512], COPIES) for i in range(0, len(points), 512)), strict=True))
    q = one.asked(sample[asks])
    score = q @ points.T
    score[np.arange(len(asks)), asks] = -np.inf
    true = np.argsort(-score, axis=1, kind="stable")[:, : min(top, len(points) - 1)]
    from_q = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + graph.square[None] - 2 * q @ graph.points.T, 0))
    floor = float(np.median(from_q.min(axis=1)) / 2)
    nearest = np.maximum(np.sort(from_q, axis=1)[:, :NEAR].mean(axis=1), floor)[:, None]
    best = None
    for close in CLOSE:
        held = far <= close * np.maximum(far[:, :1], floor) + 1e-12
        way = np.where(held[true], np.take_along_axis(from_q, lists[true].reshape(len(asks), -1), 1).reshape(lists[true].shape), np.inf).min(axis=2)
        ratio = float(np.quantile(way / nearest, RECALL, method="higher")) * (1 + 1e-9)
        read = from_q <= ratio * nearest
        size = np.bincount(lists[held], minlength=k) * (rows / len(points))
        cost = float((read @ size + OPENING * read.sum(axis=1)).mean())
        if best is None or cost < best[0]:
            best = (cost, close, ratio, float((way <= ratio * nearest).mean()), float(read.mean()), float(held.sum(axis=1).mean()))
    _, close, ratio, recall, share, copies = best
    middles = centroids(graph.points, max(1, k // CELL))
    cells = ((middles**2).sum(axis=1)[None] - 2 * graph.points @ middles.T).argmin(axis=1)
    return one._replace(graph=graph, close=close, ratio=ratio, floor=floor, cells=cells, recall=recall, share=share, copies=copies)


def _assigned(sent):
    """(id, v, list, cell, first): a row for each list that a vector goes to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for part in batches:
            for at in range(0, len(part), 512):
                few = part.iloc[at : at + 512]
                lists, far = index.graph.search(index.stored(matrix(few["v"])), COPIES)
                keep = (far <= index.reach(far, index.close)) & np.isfinite(far)
                rows = np.repeat(np.arange(len(few)), keep.sum(axis=1))
                chosen = lists[keep].astype(np.int32)
                yield pd.DataFrame(
                    {"id": few["id"].to_numpy()[rows], "v": few["v"].to_numpy()[rows], "list": chosen, "cell": index.cells[chosen].astype(np.int32), "first": (np.cumsum(keep, axis=1) == 1)[keep]}
                )

    return run


def _probes(sent, sizes: np.ndarray, top: int):
    """(query_id, q, cell, lists, home): the cells in which a query reads lists; home is that of its nearest one.

    The walk asks for more centroids as long as the farthest that it found still is to be read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        k = len(index.graph.points)
        for part in batches:
            for at in range(0, len(part), 256):
                few, width = part.iloc[at : at + 256], max(32, int(1.5 * index.share * k))
                while len(few):
                    lists, far = index.graph.search(index.asked(matrix(few["v"])), width)
                    held = np.cumsum(sizes[lists], axis=1) - sizes[lists]
                    # at least so many lists that enough candidates are in them, whatever their distance
                    read = ((far <= index.reach(far, index.ratio, NEAR)) | (held <= 4 * top)) & np.isfinite(far)
                    done = ~read[:, -1] | (lists.shape[1] == k)
                    out = []
                    for row, own in zip(np.flatnonzero(done), (lists[i][read[i]] for i in np.flatnonzero(done)), strict=True):
                        cells = index.cells[own]
                        for cell in np.unique(cells):
                            out.append((few["id"].iloc[row], few["v"].iloc[row], cell, own[cells == cell], cell == cells[0]))
                    yield pd.DataFrame(out, columns=["query_id", "q", "cell", "lists", "home"])
                    few, width = few[~done], width * 2

    return run


def _best(top: int):
    """The best of a block's candidates for each of its queries, by exact inner products; none below the query's bound."""

    def run(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, own in asked.groupby("block", sort=False) if len(stored) else ():
            there = stored[stored["block"] == block]
            by_list = dict(tuple(there.groupby("list", sort=False)))
            q, asks, least = matrix(own["q"]), own["query_id"].to_numpy(), own["bound"].to_numpy()
            reads = pd.DataFrame({"row": np.repeat(np.arange(len(own)), own["lists"].map(len)), "list": np.concatenate(own["lists"].to_list())})
            for name, rows in reads.groupby("list", sort=False)["row"]:
                if name not in by_list:
                    continue
                x, ids = matrix(by_list[name]["v"]), by_list[name]["id"].to_numpy()
                for at in range(0, len(rows), 256):
                    few = rows.to_numpy()[at : at + 256]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = np.nan_to_num(q[few] @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                        bound = least[few]
                        if score.shape[1] > top:
                            bound = np.fmax(bound, np.partition(score, -top - 1, axis=1)[:, -top - 1])
                        slack = np.where(np.isfinite(bound), 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0))), 0)
                        a, b = np.nonzero((score >= (bound - slack)[:, None]) & (asks[few][:, None] != ids[None]))
                        exact = np.nan_to_num(dots(q[few[a]], x[b]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    order = np.lexsort((ids[b], -exact, a))
                    a, b, exact = a[order], b[order], exact[order]
                    within = np.arange(len(a)) - np.searchsorted(a, a) < top
                    out.append(pd.DataFrame({"query_id": asks[few[a[within]]], "vec_id": ids[b[within]], "score": exact[within]}))
        both = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        both = both.drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return both.groupby("query_id", sort=False).head(top).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _searched(placed: DataFrame, probes: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block for each of ``probes``.

    Blocks: a cell in parts of PART rows, its queries in parts of QUERIES; each part of one meets each of the other.
    """
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    shares = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))
    loads = F.broadcast(parts.join(shares, "cell"))  # a row a cell: fewer than the lists
    of = lambda key, n: F.pmod(F.xxhash64(key, F.lit(9)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.concat_ws("-", "cell", "part", "share").alias("block")
    left = placed.join(loads, "cell").withColumn("part", of("id", "parts")).withColumn("share", every("shares")).select(block, "list", "id", "v")
    right = probes.join(loads, "cell").withColumn("share", of("query_id", "shares")).withColumn("part", every("parts")).select(block, "query_id", "q", "lists", "bound")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_best(top), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows of ``vectors`` of largest inner product found for each of ``queries``.

    Both have (vec_id, embedding); a query's own vec_id is no candidate. score is the inner product of
    the original vectors in double precision, infinite where that overflows; ties go to the smaller vec_id; fewer than
    ``top`` candidates are all returned. Vectors that are null, zero, of
    another length than most or hold null or non-finite components take no part, nor
    do rows without vec_id. Rows that repeat a vec_id count once, with its least vector.
    Without queries or candidates the result is empty. Other columns are not read.

    Centroids and ratios are fitted on about ``sample`` rows drawn by hash; every row is indexed.
    """
    spark = vectors.sparkSession
    valid = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    size = dimension(valid, "v")
    valid = cut(valid.where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    wide = F.transform("v", lambda e: F.abs(e.cast("double")))
    count, unit = valid.agg(F.count(F.lit(1)), F.max(F.array_max(wide))).first()
    asked = queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    asked = asked.where(F.col("id").isNotNull() & usable("v") & (F.size("v") == size)).groupBy("id").agg(F.min("v").alias("v"))
    if not count:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    most = valid.agg(F.sqrt(F.max(F.aggregate(wide, F.lit(0.0), lambda s, e: s + (e / unit) * (e / unit))))).first()[0]

    drawn = valid.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, sample / count) * (1 << 30))).orderBy("id")
    some = matrix(drawn.select("v").toPandas()["v"])
    if not len(some):
        some = matrix(valid.select("v").limit(1).toPandas()["v"])
    index = fitted(some, count, unit, most, top)
    sent = spark.sparkContext.broadcast(index)  # bounded by the sample: a centroid for each four of its rows

    kind = valid.schema["v"].dataType.simpleString()
    placed = cut(valid.mapInPandas(_assigned(sent), f"id long, v {kind}, list int, cell int, first boolean"), "lists")
    sizes = np.zeros(len(index.graph.points), np.int64)
    for r in placed.where("first").groupBy("list").agg(F.count(F.lit(1)).alias("own")).collect():  # a row a centroid
        sizes[r["list"]] = r["own"]
    dealt = asked.repartition(max(1, min(4_096, count // (20 * 128))), "id")
    probes = cut(dealt.mapInPandas(_probes(sent, sizes, top), f"query_id long, q {kind}, cell int, lists array<int>, home boolean"), "probes")

    low = F.lit(float("-inf"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    at_home = _searched(placed, probes.where("home").withColumn("bound", low), top)
    at_home = cut(at_home.distinct().withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).drop("rank"), "home")
    bounds = at_home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).otherwise(low).alias("bound"))
    away = probes.where(~F.col("home")).join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", low))
    found = at_home.union(_searched(placed, away, top)).distinct()
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are hashed by quantised Gaussian projections into several tables;
vectors that share a bucket are compared by exact cosine in double precision. For unit
vectors a cosine of c is a distance of sqrt(2 - 2c), which sets the width of the
quantisation; the number of projections grows with the logarithm of the rows, so that
a bucket of unrelated vectors stays small, and the number of tables makes up
for it.

Groups of copies never become all pairs. Equal vectors are one. Vectors of a fine bucket
that lie within half the linking angle of a member, drawn by the bucket's key, are one ball:
any two of them link. Balls and single vectors are the units that the tables compare;
for two units, pivots and radii mostly tell that all their members link or that none
does, and only otherwise are members compared. Two single vectors are counted in the first
table that puts them into one bucket, and a bucket returns numbers of links and a
spanning star of each of its components: never a row for each linked pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, cut, drop, grid
from siltstone.llm.vectors import dimension, dots, matrix, usable

WIDTH = 5.0  # quantisation steps: this many times the distance at the threshold
BUCKET = 512  # unrelated vectors that a bucket holds, as a mean: a product of matrices costs less than more tables
MISS = 1e-4  # chance to miss a pair just at the threshold; much less above it
FINE_TABLES, FINE_PROJECTIONS = 6, 24  # tables of fine buckets, whose members are nearly equal
SLACK = 1e-7  # radians by which a bound must be clear before it decides without members


def same_bucket(steps: float) -> float:
    """Probability that one projection puts two points into one step that is ``steps`` times their distance wide."""
    normal = 0.5 * math.erfc(steps / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * steps) * (1 - math.exp(-(steps**2) / 2))


def shape(rows: int, cosine: float) -> tuple[int, int]:
    """Projections a table and number of tables for so many rows."""
    near = math.sqrt(2 - 2 * cosine)
    far = same_bucket(WIDTH * near / math.sqrt(2))
    projections = max(4, math.ceil(math.log(max(1.0, rows / BUCKET)) / -math.log(far)))
    return projections, math.ceil(math.log(MISS) / math.log(1 - same_bucket(WIDTH) ** projections))


def _hash(x: np.ndarray, tables: int, projections: int, step: float, seed: int) -> np.ndarray:
    """The 32-bit bucket of each row in each table."""
    draw = np.random.default_rng(seed)
    lines = draw.standard_normal((x.shape[1], tables * projections))
    shift = draw.uniform(0, step, tables * projections)
    cells = np.floor((x @ lines + shift) / step).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
    key = np.zeros((len(x), tables), np.uint64)
    for i in range(projections):
        key = (key ^ cells[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.astype(np.uint32).view(np.int32)


def _hashed(classes: DataFrame, tables: int, projections: int, step: float, seed: int) -> DataFrame:
    """(id, buckets, packed, x): a vector's bucket in each table, the same as bytes, and the vector as bytes of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), 1024):
                few = part.iloc[at : at + 1024]
                x = matrix(few["v"])
                found = _hash(x, tables, projections, step, seed)
                yield pd.DataFrame({"id": few["id"], "buckets": list(found), "packed": [b.tobytes() for b in found], "x": [v.tobytes() for v in x]})

    return classes.select("id", "v").mapInPandas(run, "id long, buckets array<int>, packed binary, x binary")


def _keyed(hashed: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and key: a row for each table; the key is the table's number and the bucket."""
    rows = hashed.select(*columns, F.posexplode("buckets").alias("table", "bucket"))
    return rows.select(*columns, F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("bucket").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("key"))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _in_ball(reach: float):
    """(id, pivot, angle) of the vectors near enough to a drawn member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                angle = _angle(dots(matrix(part["v"]), matrix(part["p"])))
                keep = angle <= reach
                yield pd.DataFrame({"id": part["id"].to_numpy()[keep], "pivot": part["pivot"].to_numpy()[keep], "angle": angle[keep]})

    return run


_FOUND = "a long, b long, kind int, n long"
SINGLE, STAR, ALL, SOME = range(4)


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _in_parts(test, a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """``test`` of pairs, so many at a time that their rows stay small."""
    parts = [test(a[i : i + 32768], b[i : i + 32768]) for i in range(0, len(a), 32768)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _star(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the least row of their component, for all rows that are not the least themselves."""
    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, a, label[b])
        np.minimum.at(after, b, after[a])
        after = after[after]
        if (after == label).all():
            rows = np.flatnonzero(label != np.arange(n))
            return rows, label[rows]
        label = after


def _near_units(limit: float):
    """What a block's units are to each other, by kind.

    SINGLE: ``a`` has ``n`` links to single vectors; STAR: ``a`` and ``b`` are of one component; ALL, SOME: all members
    of the units ``a`` and ``b`` link, or some may.
    """
    surely, maybe = math.cos(limit - SLACK), math.cos(limit + SLACK)

    def block(own: pd.DataFrame, table: int, halves: bool) -> Iterator[pd.DataFrame]:
        own = own.sort_values("unit")
        ids, radius, chunk, weight, x = own["unit"].to_numpy(), own["radius"].to_numpy(), own["chunk"].to_numpy(), own["weight"].to_numpy(), _rows(own["x"], np.float64)
        lone = own["packed"].notna().to_numpy()
        buckets = np.zeros((len(own), table), np.int32)
        if table and lone.any():
            buckets[lone] = _rows(own["packed"][lone], np.int32)[:, :table]
        links, ends = np.zeros(len(own), np.int64), []
        # single precision finds who may be near, with room for its error; double precision decides
        single, least = x.astype(np.float32), math.cos(min(math.pi, limit + 2 * radius.max() + SLACK)) - 1e-5
        for at in range(0, len(ids), 256):
            a, b = np.nonzero(single[at : at + 256] @ single.T >= least)
            a += at
            fresh = (a < b) & (chunk[a] != chunk[b]) if halves else a < b
            a, b = a[fresh], b[fresh]
            cosine = _in_parts(lambda i, j: dots(x[i], x[j]), a, b, np.float64)
            both = lone[a] & lone[b]
            i, j, near = a[both], b[both], cosine[both]
            fresh = near >= maybe
            i, j, near = i[fresh], j[fresh], near[fresh]
            fresh = ~_in_parts(lambda i, j: (buckets[i] == buckets[j]).any(axis=1), i, j, bool)
            i, j, sure = i[fresh], j[fresh], near[fresh] >= surely
            yield pd.DataFrame({"a": ids[i[~sure]], "b": ids[j[~sure]], "kind": SOME, "n": 0})
            i, j = i[sure], j[sure]
            links += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
            ends.append((i, j))
            if not both.all():
                i, j, angle = a[~both], b[~both], _angle(cosine[~both])
                reach = radius[i] + radius[j]
                near = angle - reach <= limit + SLACK
                every = angle + reach <= limit - SLACK
                yield pd.DataFrame({"a": ids[i[near]], "b": ids[j[near]], "kind": np.where(every[near], ALL, SOME), "n": 0})
        rows, least = _star(*(np.concatenate(t) for t in zip(*ends, strict=True)), len(ids))
        yield pd.DataFrame({"a": ids[rows], "b": ids[least], "kind": STAR, "n": 0})
        met = np.flatnonzero(links)
        yield pd.DataFrame({"a": ids[met], "b": ids[met], "kind": SINGLE, "n": links[met]})

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        found = [f for (key, lo, hi), own in cell.groupby(["key", "lo", "hi"], sort=False) for f in block(own, int(key) >> 32, lo != hi) if len(f)]
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "kind": [], "n": []})

    return run


def _member_links(cosine: float):
    """Links of each vector with a block of another unit's members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            n = [int((np.array(w) * (dots(np.broadcast_to(np.array(x, float), (len(w), len(x))), np.array(vs.tolist(), float)) >= cosine)).sum()) for x, vs, w in zip(part["v"], part["vs"], part["ws"], strict=True)]
            yield pd.DataFrame({"id": part["id"], "a": part["a"], "b": part["b"], "n": n})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    n_links: other rows whose cosine with this one is at least ``cosine``, found
    through the tables; component_id: smallest vec_id reachable by links, itself included; kept:
    vec_id is component_id. Vectors that are null, zero, of another length than most or hold
    null or non-finite components have no link and are kept. Repeated rows are
    vectors of their own and link with each other; each returns a row. Rows without vec_id take no
    part: n_links 0, component_id null, kept. An empty table gives an empty
    result. Other columns, labels too, are not read.

    A pair just at the threshold is missed with probability 1e-4 at most, whatever the rows.
    Huge and tiny finite components count like others: vectors are divided by their largest first.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    valid = rows.where(F.col("vec_id").isNotNull() & usable("v"))
    size = dimension(valid, "v")
    # by the largest component first: squares of huge or tiny ones would overflow or vanish
    big = F.array_max(F.transform("v", F.abs))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    scaled = valid.where(F.size("v") == size).select("vec_id", F.transform("v", lambda e: e / big).alias("v"))
    unit = cut(scaled.select("vec_id", F.transform("v", lambda e: e / norm).alias("v")), "vectors")
    classes = cut(unit.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")), "classes")
    count = classes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    limit, near = math.acos(cosine), math.sqrt(2 - 2 * cosine)

    # balls: fine buckets, one drawn member each, and who is within half the linking angle of it
    fine = _keyed(_hashed(classes, FINE_TABLES, FINE_PROJECTIONS, WIDTH * near / 2, 31), "id")
    mask = F.xxhash64("key")
    pivots = fine.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("least").bitwiseXOR(mask).alias("pivot"))
    asked = fine.join(pivots, "key").select("id", "pivot").distinct()
    tested = asked.join(classes.select("id", "v"), "id").join(classes.select(F.col("id").alias("pivot"), F.col("v").alias("p")), "pivot")
    inside = tested.mapInPandas(_in_ball(limit / 2 - SLACK), "id long, pivot long, angle double")
    # prefer pivots that many share, so that a group falls into few balls
    inside = cut(inside, "inside")
    popular = inside.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    chosen = inside.join(popular, "pivot").groupBy("id").agg(F.max_by(F.struct("pivot", "angle"), F.struct("n", "pivot")).alias("c")).select("id", F.col("c.pivot").alias("unit"), F.col("c.angle").alias("angle"))
    member = classes.join(chosen, "id", "left").select("id", "v", "weight", F.coalesce("unit", F.lit(-1)).alias("pivot"), F.coalesce("angle", F.lit(0.0)).alias("angle"), F.col("unit").isNull().alias("alone"))
    # a single vector is a unit of its own; a ball is named by its pivot, which may be in another one
    member = cut(member.withColumn("unit", F.when(F.col("alone"), F.col("id") * 2).otherwise(F.col("pivot") * 2 + 1)).drop("pivot", "alone"), "members")
    drop(inside)
    pivot_id = F.floor(F.col("unit") / 2).cast("long")
    projections, tables = shape(count, cosine)
    hashed = cut(_hashed(classes, tables, projections, WIDTH * near, 32), "hashed")
    units = member.groupBy("unit").agg(F.max("angle").alias("radius"), F.sum("weight").alias("weight"), F.min("id").alias("least"), F.count(F.lit(1)).alias("classes"))
    units = units.withColumn("id", pivot_id).join(hashed.select("id", "packed", "x"), "id").drop("id")
    units = cut(units.withColumn("packed", F.when(F.col("unit") % 2 == 0, F.col("packed"))), "units")

    # units that share a bucket in one of the tables, through any of their members
    met = _keyed(hashed.join(member.select("id", "unit"), "id"), "unit").distinct()
    cells = grid(met, "key", "unit", 2048, 20_000).join(units.select("unit", "radius", "weight", "x", "packed"), "unit")
    found = cut(cells.select("key", "unit", "radius", "weight", "x", "packed", "chunk", "lo", "hi", "cell").groupBy("cell").applyInPandas(_near_units(limit), _FOUND), "found")
    drop(hashed)
    pairs = cut(found.where(F.col("kind").isin(ALL, SOME)).select("a", "b", (F.col("kind") == ALL).alias("all")).distinct(), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "all"))

    weights = units.select(F.col("unit").alias("b"), F.col("weight").alias("other"))
    single = found.where(F.col("kind") == SINGLE).select(F.col("a").alias("unit"), F.col("n").alias("other"))
    sure = both.where("all").join(weights, "b").select(F.col("a").alias("unit"), "other").union(single).groupBy("unit").agg(F.sum("other").alias("sure"))
    packed = member.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).join(units.select("unit", "classes"), "unit")
    packed = packed.withColumn("pack", F.pmod(F.col("pack"), F.ceil(F.col("classes") / 256))).groupBy(F.col("unit").alias("b"), "pack").agg(F.collect_list("v").alias("vs"), F.collect_list("weight").alias("ws"))
    open_ = both.where("not all").join(member.select(F.col("unit").alias("a"), "id", "v"), "a").join(packed, "b").select("id", "a", "b", "v", "vs", "ws")
    unsure = cut(open_.mapInPandas(_member_links(cosine), "id long, a long, b long, n long").where("n > 0").groupBy("id", "a", "b").agg(F.sum("n").alias("n")), "unsure")

    stars = found.where(F.col("kind") == STAR).select("a", "b")
    edges = pairs.where("all").select("a", "b").union(unsure.select("a", "b")).union(stars).distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = components(edges)
    grouped = units.join(labels.withColumnRenamed("id", "unit"), "unit", "left").withColumn("label", F.coalesce("component_id", "unit")).drop("component_id")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of_unit = grouped.join(least, "label").join(sure, "unit", "left").select("unit", "component_id", (F.col("weight") + F.coalesce("sure", F.lit(0))).alias("reached"))
    partly = unsure.groupBy("id").agg(F.sum("n").alias("partly"))
    of_class = member.join(of_unit, "unit").join(partly, "id", "left").select("v", (F.col("reached") + F.coalesce("partly", F.lit(0)) - 1).alias("n_links"), "component_id")

    linked = unit.join(of_class, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    apart = rows.where(F.col("vec_id").isNull() | ~usable("v") | F.coalesce(F.size("v") != size, F.lit(True)))
    return linked.union(apart.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(True)))

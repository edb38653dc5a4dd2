"""Ranking: BM25, sparse and dense scores, fusion, normalisation, reranking, metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import sparse_index
from siltstone.functions.vectors import dcg, finite
from siltstone.operators.relational import top_per_key
from siltstone.operators.search_index import best_by_blocks, counted, exploded, rarity, saturated
from siltstone.storage import cut


def counts_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Documents' counted tokens, cut: every figure of a ranking then starts from files instead of the texts."""
    return cut(counted(docs, doc, text), "counted")


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Best ``k`` documents of every query by BM25: (query, doc, score, rank); ties to the smaller doc.

    Texts are read once, unless ``counts`` of them are there already. Corpus figures are two numbers.
    """
    counts = counts_of(docs, doc, text) if counts is None else counts
    asked = cut(exploded(counted(queries, query, text), query).select(query, "token").distinct(), "asked")
    n_docs, total = counts.agg(F.count(F.lit(1)), F.sum("length")).first()
    df = counts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(asked.select("token"), "token", "left_semi")
    asked = cut(asked.join(df, "token").select(query, "token", rarity(n_docs, F.col("df")).alias("worth")), "asked")
    return best_by_blocks(counts.select(doc, "length", "tokens", "tfs"), asked, doc, query, k, saturated((total or 0) / max(n_docs, 1)))


def sparse_vectors(docs: DataFrame, doc: str, text: str, version: str, counts: DataFrame | None = None) -> DataFrame:
    """(doc, token, index, value): saturated counts at hashed indices; tokens that collide stay rows of their own."""
    rows = exploded(counts_of(docs, doc, text) if counts is None else counts, doc, runs=True)
    return rows.select(doc, "token", sparse_index(version, F.col("token")).alias("index"), (F.col("tf") * 2.2 / (F.col("tf") + 1.2)).alias("value"))


def sparse_search(counts: DataFrame, asked: DataFrame, doc: str, query: str, version: str, k: int) -> DataFrame:
    """Best ``k`` documents of every query by inner product of sparse vectors, of ``counts`` and of ``asked`` (query, index, value).

    Tokens are hashed once each, not once a document. Values are above 0.
    """
    words = exploded(counts, doc, runs=True).select("token").distinct().withColumn("index", sparse_index(version, F.col("token")))
    met = words.join(asked.select(query, "index", F.col("value").alias("worth")), "index").groupBy(query, "token").agg(F.sum("worth").alias("worth"))
    rows = counts.select(doc, "length", F.coalesce("runs", "tokens").alias("tokens"), F.coalesce("run_tfs", "tfs").alias("tfs"))
    return best_by_blocks(rows, cut(met, "met"), doc, query, k, lambda tf, _: tf * 2.2 / (tf + 1.2))


BLOCK = 8_192  # vectors that a block of dense search holds, as a mean


def _block_best(k: int):
    """The best ``k`` of a block for each query by cosine, with what a rounding to six digits may tie with them."""

    def run(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(stored) and len(asked):
            x, q = (np.array(df[c].tolist(), np.float64) for df, c in ((stored, "v"), (asked, "q")))
            ids, asks = stored["id"].to_numpy(), asked["query_id"].to_numpy()
            xn, qn = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (q[part] @ x.T) / (qn[part, None] * xn[None])
                score[(asks[part, None] == ids[None]) | ~np.isfinite(score)] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(score), -np.inf)
                a, b = np.nonzero((score >= least[:, None] - 2e-6) & np.isfinite(score))
                out.append(pd.DataFrame({"query_id": asks[part][a], "id": ids[b], "score": score[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    return run


def dense_search(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of ``vectors`` for every row of ``asked`` (both id, v) by cosine, itself excluded: (query_id, id, score, rank).

    The queries are a stated set, in blocks against blocks of all rows: a block is a product of
    matrices, and only its best leave it. Blocks are as many as the rows ask for.
    """
    sure = lambda df: df.where(finite(F.col("v")))
    n = max(1, -(-vectors.count() // BLOCK))
    left = sure(vectors).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    right = sure(asked).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    best = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_block_best(k), "query_id long, id long, score double")
    return top_per_key(best.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.col("id")], k)


def reciprocal_rank_fusion(lists: list[DataFrame], query: str, doc: str, k: int = 60) -> DataFrame:
    """Fused score of ranked lists (query, doc, rank): the sum of 1 / (k + rank)."""
    parts = [x.select(query, doc, (1.0 / (k + F.col("rank"))).alias("part")) for x in lists]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy(query, doc).agg(F.round(F.sum("part"), 9).alias("score"), F.count(F.lit(1)).alias("n_lists"))


def min_max(df: DataFrame, query: str, score: str = "score") -> DataFrame:
    """Scores of a query spread over 0 to 1; equal ones are all 1."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("normalized", F.round(F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0), 6))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted sum of components, each clamped to 0 to 1 and null as 0."""
    total = F.lit(0.0)
    for value, weight in parts.values():
        total = total + weight * F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), F.lit(0.0))
    return total


def level(score: Column, strong: float, good: float, possible: float) -> Column:
    return F.when(score >= strong, "strong").when(score >= good, "good").when(score >= possible, "possible").otherwise("weak")


def retrieval_metrics(candidates: DataFrame, judgments: DataFrame, query: str, doc: str) -> DataFrame:
    """nDCG@10, pooled recall@20 and whether the first ten lack a relevant one, a row a query of ``candidates``.

    ``judgments`` (query, doc, grade): the ideal order and the pool come from them. A
    candidate without judgment has grade 0.
    """
    pool = judgments.groupBy(query).agg(F.count_if(F.col("grade") > 0).alias("relevant_in_pool"))
    ideal = top_per_key(judgments, [query], [F.desc("grade"), F.col(doc)], 10).groupBy(query).agg(F.sum(dcg(F.col("grade"), F.col("rank"))).alias("ideal"))
    graded = candidates.where("rank <= 20").join(judgments, [query, doc], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    ten = F.col("rank") <= 10
    got = graded.groupBy(query).agg(
        F.sum(F.when(ten, dcg(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("gain"), F.count_if(F.col("grade") > 0).alias("found"), F.count_if(ten & (F.col("grade") > 0)).alias("found_in_ten")
    )
    safe = lambda a, b: F.round(F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0)), 6)
    return got.join(pool, query, "left").join(ideal, query, "left").select(
        query, safe(F.col("gain"), F.col("ideal")).alias("ndcg_at_10"), safe(F.col("found").cast("double"), F.col("relevant_in_pool")).alias("recall_at_20"), (F.col("found_in_ten") == 0).alias("none_in_ten")
    )


def macro(metrics: DataFrame) -> DataFrame:
    """(queries, ndcg_at_10, recall_at_20, none_in_ten): means of :func:`retrieval_metrics` over queries, and the share without a relevant one in ten."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return metrics.agg(F.count(F.lit(1)).alias("queries"), mean("ndcg_at_10"), mean("recall_at_20"), F.round(F.avg(F.col("none_in_ten").cast("int")), 6).alias("none_in_ten"))

"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled texts are drawn from all
texts, whether somebody rated them or not. A linear classifier over hashed word and
word-beginning features minimises the non-negative risk

    pi * R_p(+)  +  max(0, R_u(-) - pi * R_p(-))

where pi is the class prior, which the ratings give. When the second term goes below
zero the step turns round, so the model can't fit unlabelled positives as negatives.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm.common import cut, drop, sliced, small_batches

SAMPLE = 6_000  # positives, and unlabelled texts, that a fit draws at most (as the mean of a hash sample)
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_KEEP = 100_000  # words whose features a worker keeps: about 40 MB


#: What turns the hash of a feature into that of "twice" and "three times or more".
_AGAIN = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)


def _features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of four to seven letters."""
    own = [f"={word}"] + [f"^{word[:n]}" for n in range(4, 8) if len(word) >= n]
    return [xxh64_intdigest(x) >> 1 for x in own]


class _Memo(dict):
    """Features of a word, only those in ``wanted`` if that is given."""

    def __init__(self, wanted: dict[int, float] | None = None):
        self.wanted = None if wanted is None else {i ^ x for i in wanted for x in _AGAIN}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _KEEP:
            self.clear()
        self[word] = found = tuple(i for i in _features(word) if self.wanted is None or i in self.wanted)
        return found


def _slots(text: str | None, memo: _Memo) -> set[int]:
    """Features of a text: a word or a beginning met once, twice, three times or more."""
    met: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for i in memo[word]:
            met[i] += n
    return {i ^ x for i, n in met.items() for x in _AGAIN[:n]}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Memo()
    for batch in sliced(batches, 1):
        for flag, text in zip(batch.column(0), batch.column(1), strict=True):
            found = np.fromiter(_slots(text.as_py(), memo), np.int64)
            yield pa.RecordBatch.from_arrays([pa.repeat(flag, len(found)), pa.array(found)], ["positive", "slot"])


def _told(telling: list[int]):
    """Which telling features each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = dict.fromkeys(telling, 0.0)
        memo = _Memo(wanted)
        for batch in sliced(batches, 1):
            found = [sorted(i for i in _slots(text.as_py(), memo) if i in wanted) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["positive", "slots"])

    return run


def training_fold(doc_id: str = "doc_id"):
    """Rows whose label may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[dict[int, float], float]:
    """Weights and bias from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of the training fold.

    Positives and unlabelled texts are drawn by a hash of doc_id at the rate that gives
    ``sample`` of each (all, if fewer), so the fit is the same at every run. The prior
    is the share of toxic among all ratings of the fold. A doc_id rated more than
    once is toxic if one rating says so; null ratings count as none. Without any
    positive there is no weight and every score is 0.001.
    """
    small_batches(docs.sparkSession)
    rated = labels.where(training_fold() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = rated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    prior = toxic / total if total else 0.0
    if not toxic:
        return {}, math.log(1e-3)
    everyone = docs.where("doc_id is not null").select("doc_id").agg(F.count(F.lit(1))).first()[0]
    order = F.xxhash64("doc_id", F.lit(seed))
    drawn = lambda n: F.pmod(order, F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    positives = rated.where("toxic = 1").where(drawn(toxic)).select("doc_id", F.lit(True).alias("positive"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(training_fold())
    # ``positives`` is a sample of SAMPLE ids, so it may be broadcast
    unlabelled = chosen.where(drawn(everyone * 2 // 3))
    marked = unlabelled.select(F.lit(False).alias("positive"), "text")
    known = chosen.join(F.broadcast(positives), "doc_id").select("positive", "text")
    texts = cut(marked.union(known), "sampled")
    many = dict(texts.groupBy("positive").agg(F.count(F.lit(1))).collect())
    telling = _telling(texts, many.get(True, 0), many.get(False, 0), prior)
    rows = texts.mapInArrow(_told(telling), "positive boolean, slots array<bigint>").toArrow()
    drop(texts)
    # in an order of their own: sums of the fit then don't depend on the order of files
    pairs = sorted(zip(rows["positive"].to_pylist(), rows["slots"].to_pylist(), strict=True))
    return _minimise(telling, [x for f, x in pairs if f], [x for f, x in pairs if not f], prior)


def _telling(texts: DataFrame, positive: int, unlabelled: int, prior: float) -> list[int]:
    """Sorted features of which, one deviation under their count in positives, half the texts are still toxic.

    That share is prior * P(feature | positive) / P(feature), by Bayes. ``texts``
    (positive, text) are counted whole, a feature once a text, in Spark; only the
    features that tell come to the driver.
    """
    if not positive or not unlabelled:
        return []
    p, u = F.count_if("positive"), F.count_if(~F.col("positive"))
    counted = texts.mapInArrow(_hashed, "positive boolean, slot bigint").groupBy("slot").agg(p.alias("p"), u.alias("u")).where("p >= 3")
    low = (F.col("p") - F.sqrt("p")) / F.lit(float(positive))
    found = counted.where(F.lit(2 * prior) * low >= (F.col("u") + 1) / F.lit(float(unlabelled))).select("slot").toArrow()
    return sorted(found["slot"].to_pylist())


def _minimise(telling: list[int], positive: list[list[int]], unlabelled: list[list[int]], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[dict[int, float], float]:
    """Adam on the non-negative risk with logistic loss over the telling features."""
    if not positive or not unlabelled:
        return {}, math.log(1e-3)
    place = {x: i for i, x in enumerate(telling)}
    slots = [np.array([place[i] for i in x], np.int64) for x in positive + unlabelled]
    flat = np.concatenate(slots)
    row = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    n, many = len(positive), len(slots)
    w, mean, spread = (np.zeros(len(telling) + 1) for _ in range(3))
    w[-1] = -2.0
    cost = lambda c: -np.log(np.clip(1 - c, 1e-12, 1)).mean()  # noqa: E731  # logistic loss of the label "not toxic"
    for t in range(1, steps + 1):
        chance = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(row, w[flat], many), -30, 30)))
        cp, cu = chance[:n], chance[n:]
        if cost(cu) - prior * cost(cp) >= 0:
            slope = np.concatenate([prior * (cp - 1) - prior * cp, cu * n / len(cu)]) / n
        else:  # the risk of "not toxic" fell below zero: turn its step round
            slope = np.concatenate([prior * cp, -cu * n / len(cu)]) / n
        step = np.append(np.bincount(flat, slope[row], len(telling)), slope.sum()) + decay * w
        mean, spread = 0.9 * mean + 0.1 * step, 0.999 * spread + 0.001 * step**2
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-9)
    return dict(zip(telling, w[:-1].tolist(), strict=True)), float(w[-1])


def _scores(texts: pa.Array, weight: dict[int, float], bias: float, memo: _Memo) -> list[float]:
    """Score of each text; sums run in order of the features, so equal texts score alike."""
    out = []
    for text in texts:
        total = bias + sum(weight[i] for i in sorted(_slots(text.as_py(), memo)) if i in weight)
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
    return out


def score(docs: DataFrame, weight: dict[int, float], bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    The text alone counts: labels, lang, source and doc_id are no inputs. Null and empty
    texts get the score of a text without features. held_out is null where doc_id
    is. Repeated rows score alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((weight, bias))  # at most the features of the sampled positives, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        memo = _Memo(weight)
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), weight, bias, memo), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (~training_fold()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels' training fold and score every row of ``docs``."""
    weight, bias = fit(docs, labels)
    return score(docs, weight, bias, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns and other rows as they are.

    Rows are kept or left where they are read, without a join, so rows that repeat a
    doc_id or have none are judged by their own texts.
    """
    weight, bias = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((weight, bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        memo = _Memo(weight)
        for batch in sliced(batches, at):
            yield batch.filter(pa.array([s < threshold for s in _scores(batch.column(at), weight, bias, memo)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

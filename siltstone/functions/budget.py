"""Texts within a budget of a tokenizer's tokens."""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _tokenizer(path: str):
    """The tokenizer of a file of the tokenizers library, once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def version(path: str) -> str:
    """The digest of a tokenizer's file: profiles of another one are other profiles."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def cut(text: str, budget: int, path: str) -> str:
    """The characters of ``text`` before the first token that ``budget`` tokens don't reach; a token that ends within a character doesn't count it.

    Of a long text only so much of its beginning is encoded as settles that: words but the last two of a beginning are those of the whole text.
    """
    own, size = _tokenizer(path), max(256, 8 * budget)
    while True:
        part = text[:size]
        found = own.encode(part, add_special_tokens=False)
        if size >= len(text):
            return text if len(found.ids) <= budget else text[: found.offsets[budget][0]]
        last = max((w for w in found.word_ids if w is not None), default=0)
        settled = sum(1 for w in found.word_ids if w is not None and w < last - 1)
        if settled > budget:
            return text[: found.offsets[budget][0]]
        size *= 4


def within_tokens(text: Column, budget: int, path: str) -> Column:
    """``text`` cut to ``budget`` tokens of the tokenizer at ``path``, which executors must have there too. Null stays null."""

    @F.arrow_udf("string")  # of a batch, not an iterator: Spark gives each iterator a worker, and each worker has a tokenizer
    def run(part: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else cut(t, budget, path) for x in part], pa.string())

    return run(text)


def each_within_tokens(texts: list[Column], budgets: list[int], path: str) -> Column:
    """An array of ``texts``, each cut to its budget as by :func:`within_tokens`, in one evaluation."""

    @F.arrow_udf("array<string>")
    def run(part: pa.Array) -> pa.Array:
        return pa.array([[None if t is None else cut(t, n, path) for t, n in zip(x.as_py(), budgets, strict=True)] for x in part], pa.list_(pa.string()))

    return run(F.array(*texts))


def tokens(text: Column, path: str) -> Column:
    """How many tokens a text has; null has none."""

    @F.arrow_udf("long")
    def run(part: pa.Array) -> pa.Array:
        own = _tokenizer(path)
        return pa.array([len(own.encode(x.as_py() or "", add_special_tokens=False).ids) for x in part], pa.int64())

    return run(text)

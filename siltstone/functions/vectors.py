"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(BinaryType())
def blob(v: pd.Series) -> pd.Series:
    """A vector as little-endian single precision; its digest is the vector's checksum."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(b: pd.Series) -> pd.Series:
    """The vector of a blob; null where its length is none of a vector or a component isn't finite."""

    def read(x: bytes | None) -> np.ndarray | None:
        if x is None or not x or len(x) % 4:
            return None
        v = np.frombuffer(x, "<f4")
        return v if np.isfinite(v).all() else None

    return b.map(read)


def checksum(v: Column) -> Column:
    return F.sha2(blob(v), 256)


def finite(v: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def dcg(grade: Column, rank: Column) -> Column:
    """A row's share of the discounted cumulative gain; ranks from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)

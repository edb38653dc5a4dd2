"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: str) -> Column:
    """A vector without null or non-finite components that isn't zero."""
    inf = F.lit(float("inf"))
    x = F.col(v)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf)) & F.exists(x, lambda e: e != 0)
    return F.coalesce(fine, F.lit(False))


def dimension(df: DataFrame, v: str) -> int:
    """The commonest length, of equally common ones the longest; others take no part."""
    first = df.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pd.Series) -> np.ndarray:
    """Rows as doubles."""
    return np.array(column.tolist(), dtype=np.float64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row: equal rows give equal values, wherever they stand."""
    return (a * b).sum(axis=1)

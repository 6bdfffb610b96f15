"""Helpers of the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is of the table's most frequent length, finite throughout and not zero.

    Vectors that are null, hold null or non-finite components, or are zero take no part;
    nor do those of another length, which nothing could be compared with.
    """
    x = F.col(vector)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    good = df.filter(F.coalesce(whole, F.lit(False)))
    lengths = good.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size(x) == (lengths[0]["n"] if lengths else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def chi_square_cdf(x: float, freedom: int) -> float:
    """P(chi-square with ``freedom`` degrees <= x), by the series of the lower incomplete gamma function."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    a, h = freedom / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= h / (a + n)
        total += term
        n += 1
    return min(1.0, total * exp(a * log(h) - h - lgamma(a)))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high

"""Vectors of embeddings as whole numbers, shared by the operators that count with them exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(embeddings: DataFrame, *more: str) -> tuple[DataFrame, int]:
    """(vec_id, v, more) of the rows whose vector holds neither null nor a non-finite component, and the vectors' length.

    Vectors of one table have one length. Where they don't, the commonest counts (the longest of several), and rows with others are left
    out, as are empty vectors. An empty table has length 0.
    """
    v, infinite = F.col("v"), float("inf")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *more)
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & (F.size(v) > 0))
    top = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    length = top["size"] if top else 0
    return rows.where(F.size(v) == length), length


def whole(column, factor: int, length: int, largest: int) -> np.ndarray:
    """floor(factor * x) of a batch's vectors, a row each; `factor` is a power of two, so the product is exact. Numbers of `largest` and more fail."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    scaled = np.floor(flat.astype(np.float64) * factor)
    if len(scaled) and not np.abs(scaled).max() < largest:
        raise ValueError(f"a component times {factor} is beyond {largest}, so that sums of squares wouldn't fit 64 bits")
    return scaled.astype(np.int64).reshape(-1, length)

"""Vectors as both vector operators see them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not NULL, not zero, and all components finite numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def with_hashes(rows: DataFrame) -> DataFrame:
    """``h1, h2``: 128 bits that stand for the vector, and ``dim``, its length."""
    v = F.col("embedding")
    return rows.withColumns({"h1": F.xxhash64(F.lit(1), v), "h2": F.xxhash64(F.lit(2), v), "dim": F.size(v)})


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as double rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no vanishing norm
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))

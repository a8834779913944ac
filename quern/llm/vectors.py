"""Rows of an embedding table that can take part: what the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Not null, not empty, finite in every component, not all zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(col).isNotNull() & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def width(df: DataFrame, col: str) -> int:
    """The commonest length of the usable vectors (of equals the greater); 0 without any."""
    got = df.where(usable(col)).groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return got["n"] if got else 0


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows that belong together. The order of the additions depends on the length
    only, so equal vectors have equal products wherever they lie."""
    return np.add.reduce(np.ascontiguousarray(x * y), axis=1)

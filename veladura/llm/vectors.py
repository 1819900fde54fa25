"""Vectors as whole numbers, for operators whose results must be exact.

Components become ``floor(scale * x)``, kept as 64-bit integers.  Distances then are sums
of squares of integers, equal on every machine and in any order of summing.  A vector with
a component beyond ``bound(dim)`` would overflow them and is not ``whole``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import ship

ship(__name__)

SCALE = 1024
#: Rows that are worked on together; bounds a task's memory beside its input batch.
BLOCK = 2048


def bound(dim: int) -> int:
    """Components up to here keep ``dim * dim * (2 * component)**2`` within 64 bits."""
    return 2**30 // max(dim, 1)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x_is_finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, x_is_finite), F.lit(False))


def whole(vector: Column, dim: int, scale: int = SCALE) -> Column:
    """The vector's components as integers; null if it has another length or exceeds the bound."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * float(scale)) < float(bound(dim)))
    return F.when((F.size(vector) == dim) & fits, scaled)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's integer vectors, one per row.  None of them is null."""
    values = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(values, dtype=np.int64).reshape(-1, dim)


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``left`` to each row of ``right``."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    largest = int(max(np.abs(left).max(), np.abs(right).max()))
    if 4 * left.shape[1] * largest * largest < 2**53:  # whole numbers that doubles hold exactly
        a, b = left.astype(np.float64), right.astype(np.float64)
        both = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return both.astype(np.int64)
    out = np.empty((len(left), len(right)), dtype=np.int64)
    for j, row in enumerate(right):
        out[:, j] = ((left - row) ** 2).sum(1)
    return out


def summed(df: DataFrame, slot: str = "slot", total: str = "total") -> dict[int, int]:
    """Sums by slot.  The caller's slots are as many as its model has numbers, whatever the input."""
    rows = df.groupBy(slot).agg(F.sum(F.col(total).cast("decimal(38,0)")).alias("s")).collect()
    return {r[0]: int(r[1]) for r in rows}

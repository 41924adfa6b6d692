"""Vectors as integers, with exact squared distances between them: shared by the operators that cluster and code vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this count as this, so that squared distances of 64 components fit a long.
LARGEST = 1 << 27
#: Up to this size, products and sums of 64 components are exact in double precision.
EXACT = 1 << 22
#: Numbers held at once by a step of a task.
CELLS = 1 << 21


def finite(v: Column) -> Column:
    """Whether an array is there and holds neither nulls nor values that aren't finite."""
    inf = F.lit(float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < inf)), F.lit(False))


def floors(v: Column, scale: float, fine: Column) -> Column:
    """floor(scale * x) of every component as an array of ints, within LARGEST either way; null where `fine` doesn't hold."""
    low, high = F.lit(-float(LARGEST)), F.lit(float(LARGEST))
    return F.when(fine, F.transform(v, lambda e: F.floor(F.greatest(low, F.least(high, e.cast("double") * F.lit(float(scale))))).cast("int")))


def matrix(column, width: int) -> np.ndarray:
    """(rows, width) of a column of lists of `width` ints each."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.asarray(a.offsets)
    return np.asarray(a.values)[at[0] : at[-1]].astype(np.int64).reshape(-1, width) if len(a) else np.zeros((0, width), np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of c)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(1, x.shape[1] / 64) <= EXACT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] + (g * g).sum(axis=1)[None, :] - 2 * (f @ g.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    step = max(1, CELLS // max(1, x.shape[1]))
    for j, row in enumerate(c):
        for i in range(0, len(x), step):
            d = x[i : i + step] - row
            out[i : i + step, j] = np.einsum("nd,nd->n", d, d)
    return out


def two_nearest(sq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first column of the smallest value, its value, second smallest value) of every row, as (int, long, double); the last is infinite in one column."""
    rows, best = np.arange(len(sq)), sq.argmin(axis=1)
    least = sq[rows, best]
    if sq.shape[1] < 2:
        return best, least, np.full(len(sq), np.inf)
    return best, least, np.partition(sq, 1, axis=1)[:, 1].astype(np.float64)

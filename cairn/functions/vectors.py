"""Vector expressions on array<double> columns and conversions to numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


#: Distances that are worked on at once: they stay in a core's cache.
CACHED = 1 << 17


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between two blocks of rows, a few rows of ``a`` at once and in place."""
    out = np.empty((len(a), len(b)))
    if not out.size:
        return out
    step = max(1, CACHED // len(b))
    if metric == "manhattan":
        flat = np.ascontiguousarray(b.T)
        gap = np.empty((step, len(b)))
        for at in range(0, len(a), step):
            own, d = a[at : at + step], out[at : at + step]
            t = gap[: len(own)]
            d[:] = 0
            for k in range(a.shape[1]):
                np.subtract(own[:, k, None], flat[k], out=t)
                np.abs(t, out=t)
                d += t
        return out
    size_a, size_b, turned = (a * a).sum(1), (b * b).sum(1), np.ascontiguousarray(-2 * b.T)
    most = np.fmax.reduce(size_b)
    for at in range(0, len(a), step):
        d, own = out[at : at + step], size_a[at : at + step]
        np.matmul(a[at : at + step], turned, out=d)
        d += own[:, None]
        d += size_b
        near = np.flatnonzero(np.fmin.reduce(d, axis=1) < 1e-9 * (own + most))
        if len(near):  # cancellation: those few again, by differences
            i, j = np.nonzero(d[near] < 1e-9 * (own[near, None] + size_b))
            i = near[i]
            d[i, j] = ((a[at + i] - b[j]) ** 2).sum(1)
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
    return out

"""Whole-number vectors for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there, has components, and none of them is null or not finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~odd, F.lit(False))


def common_length(vectors: DataFrame, vec_col: str, multiple: int = 1) -> int:
    """The commonest length of usable vectors among the multiples of ``multiple`` (ties: the shorter); 0 if there is none."""
    lengths = vectors.filter(finite(F.col(vec_col))).groupBy(F.size(vec_col).alias("dim")).count().filter(F.col("dim") % multiple == 0)
    first = lengths.orderBy(F.desc("count"), "dim").limit(1).collect()
    return first[0]["dim"] if first else 0


def whole_numbers(vectors: pa.Array, dim: int, factor: int = 256) -> np.ndarray:
    """floor(factor * x) of every component, as (rows, dim) int64; ``vectors`` have ``dim`` components each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(factor * flat).astype(np.int64).reshape(-1, dim)


def narrowest(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest of 2, 4 and 8 bytes that hold all of it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def packed(x: np.ndarray) -> list[bytes]:
    """Every row of ``x`` as bytes, in the narrowest form of that row, so that equal rows have equal bytes."""
    most = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for low, high, kind in ((0, 1 << 15, "<i2"), (1 << 15, 1 << 31, "<i4"), (1 << 31, np.inf, "<i8")):
        at = np.flatnonzero((most >= low) & (most < high))
        raw, width = x[at].astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
        for k, i in enumerate(at.tolist()):
            out[i] = raw[k * width : (k + 1) * width]
    return out


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """The rows that ``packed`` gave, as (rows, dim) int64, in any order."""
    parts = [np.frombuffer(b"".join(r for r in rows if len(r) == dim * w), f"<i{w}").reshape(-1, dim).astype(np.int64) for w in (2, 4, 8)]
    return np.concatenate(parts)

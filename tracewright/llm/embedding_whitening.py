"""Whitening of embeddings along the leading directions of their covariance, by LOBPCG.

Vectors become whole numbers; each different one counts once in the fit. The fit list is
written once to the shared folder as blocks of rows. A step of the iteration multiplies the
covariance with a block of directions, ``(X - m)' ((X - m) W) / n``, summed over the blocks by
``treeAggregate``; only matrices of dimension times block width reach the driver. Rayleigh-Ritz
on the span of iterate, residual and previous direction gives the next iterate. It ends when
the residuals of all components asked for are certified: ``|V u - e u| <= tolerance * e1`` from
a product with the iterate itself, not from updates of one.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no
part; nor do those of another length than the commonest (ties: the shorter). Rows that repeat
an id or a vector each come back; null ids are kept. Components are those with an eigenvalue
above the rounding of the trace, so that vectors that span fewer dimensions have fewer
components, and a single vector, or an empty table, gives no rows. Of equal eigenvalues any
unit directions of their space may stand. ``deviation`` is null where it leaves 64 bits. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import cut, slices
from tracewright.llm._vectors import common_length, finite, narrowest, packed, unpacked, whole_numbers

#: Directions beyond those asked for, which speed up the last ones; steps at most; certified residual.
GUARDS, STEPS, TOLERANCE = 12, 1000, 1e-13
#: Bytes of the fit list in one task.
TASK_BYTES = 32 << 20


def fit_blocks(vectors: DataFrame, vec_col: str, dim: int) -> RDD:
    """(n, dim) arrays that hold each different whole-number vector once."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole_numbers(part.column(0), dim)), pa.binary())], ["x"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 10_000):
                x = narrowest(unpacked(part.column(0).to_pylist(), dim))
                yield pa.RecordBatch.from_arrays([pa.array([x.dtype.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["width", "rows"])

    once = vectors.select(vec_col).mapInArrow(keys, "x binary").distinct()  # copies meet before the shuffle and after it
    made = cut(once.mapInArrow(blocks, "width int, rows binary"))
    held = made.agg(F.sum(F.length("rows"))).first()[0] or 0  # every step is a job: its tasks should each have enough to do
    return made.rdd.coalesce(max(made.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES))).map(lambda r: np.frombuffer(r["rows"], f"<i{r['width']}").reshape(-1, dim))


def summed(blocks: RDD, of: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sum of ``of(block)``, a tuple of arrays, through a tree of reducers."""

    def both(a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))

    return blocks.treeAggregate(None, lambda held, block: both(held, of(block)), both)


def orthonormal(new: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Orthonormal directions of the columns of ``new`` that lie outside the span of ``held``."""
    size = np.sqrt((new**2).sum(axis=0))
    new = new[:, size > 0] / size[size > 0]
    for _ in range(3):  # once is not enough in double precision; each time what has nearly vanished goes
        new = new - held @ (held.T @ new)
        size = np.sqrt((new**2).sum(axis=0))
        new = new[:, size > 1e-12] / size[size > 1e-12]
    if not new.shape[1]:
        return new
    left, singular, _ = np.linalg.svd(new, full_matrices=False)
    left = left[:, singular > 1e-10]
    return np.linalg.qr(left - held @ (held.T @ left))[0]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 0, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, their unit vectors and their residual norms.

    ``product(W)`` is the symmetric matrix times W; one call a step.
    """
    width, k = min(dim, k + GUARDS), min(dim, k)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    basis = x
    for _ in range(steps):
        image = product(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        before, x, vx = x.shape[1], basis @ turn, image @ turn
        residual = vx - x * values
        norms = np.sqrt((residual**2).sum(axis=0))
        if (norms[:k] <= tolerance * max(values[0], 0.0)).all():
            return values[:k], x[:, :k], norms[:k]
        q, r = np.linalg.qr(x)  # rounding must not gather over the steps
        x = q * np.sign(np.diag(r))
        previous = basis[:, before:] @ turn[before:]
        fresh = orthonormal(residual, x)
        spanned = np.concatenate([x, fresh], axis=1)
        basis = np.concatenate([spanned, orthonormal(previous, spanned)], axis=1) if previous.size else spanned
    raise ArithmeticError(f"residuals {norms[:k]} after {steps} steps")


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = common_length(vectors, vec_col)
    kept = vectors.filter(finite(F.col(vec_col)) & (F.size(vec_col) == dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = fit_blocks(kept, "vec", dim)
    n, total = summed(blocks, lambda b: (len(b), b.sum(axis=0, dtype=np.int64)))
    n, mean = int(n), total / int(n)

    def centred(w: np.ndarray) -> np.ndarray:
        def of(b: np.ndarray) -> tuple[np.ndarray]:
            c = b - mean
            return (c.T @ (c @ w),)

        return summed(blocks, of)[0] / n

    trace = float(summed(blocks, lambda b: (((b - mean) ** 2).sum(),))[0]) / n
    if trace == 0.0:
        return vectors.sparkSession.createDataFrame([], schema)
    values, directions, _ = lobpcg(centred, dim, components)
    real = values > 1e-13 * dim * trace
    values, directions = values[real], directions[:, real]
    scaled = directions / np.sqrt(values)

    def moments(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (b - mean) @ scaled
        return z.sum(axis=0), z.T @ z

    first, second = summed(blocks, moments)
    error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(len(values))).max())
    return kept.mapInArrow(_rows(dim, n, total, mean, scaled, values / trace, error), schema)


def _rows(dim: int, n: int, total: np.ndarray, mean: np.ndarray, scaled: np.ndarray, explained: np.ndarray, error: float) -> Callable:
    """One row per vector and component, for ``mapInArrow``."""
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 10_000):
                x = whole_numbers(part.column("vec"), dim)
                rows = len(x)
                about = ((float(n) * x - total) ** 2).sum(axis=1)
                with np.errstate(over="ignore"):
                    exact = ((n * x - total) ** 2).sum(axis=1)  # wraps around, but back again where the result has 64 bits
                columns = (
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(np.repeat(exact, k), mask=np.repeat(about > 9.2e18, k)),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                )
                yield pa.RecordBatch.from_arrays(list(columns), ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run

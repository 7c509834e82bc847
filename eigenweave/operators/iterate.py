"""Distributed subspace iteration.

Z = sum of X_k'(X_k V) is N times the pooled second moment times V. Where the d x d matrix fits the
driver, one aggregation builds it and the iteration costs no job; else no d x d matrix is made anywhere:
one job finds count, mean and total variance, and every iteration is one job that broadcasts V and
sums d x k partial products in a tree. Both have the same fixed point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame

from ..sources.samples import dimension
from .combine import pooled_moments
from .linalg import canonical
from .model import PCAModel
from .stats import merge_tree, party_stats, tasks_of, vectors

#: Features up to which the pooled matrix is held on the driver (8 d^2 bytes).
MATRIX_DIMS = 4096


def _summed(frame: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """fold(total, rows) over all rows' matrices, summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zero.copy()
        for b in batches:
            if b.num_rows:
                z = fold(z, vectors(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([z.ravel()], pa.list_(pa.float64()))], ["task", "z"])

    parts = frame.select("features").mapInArrow(run, "task int, z array<double>")
    add = lambda held, r: np.asarray(r["z"], float) if held is None else held + np.asarray(r["z"], float)
    rows = merge_tree(parts, [], add, lambda z: {"z": z}, tasks_of(frame)).collect()
    return np.sum([np.array(r["z"]) for r in rows], axis=0).reshape(zero.shape)


def _product(frame: DataFrame, mean: np.ndarray, v: np.ndarray) -> np.ndarray:
    def fold(z: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x - mean
        return z + x.T @ (x @ v)

    return _summed(frame, fold, np.zeros(v.shape))


def plain_moments(frame: DataFrame, d: int) -> tuple[int, np.ndarray, float]:
    """Rows, mean and N times the total variance, without a d x d matrix."""
    total = _summed(frame, lambda z, x: z + np.concatenate((x.sum(axis=0), [len(x)])), np.zeros(d + 1))
    n = int(total[-1])
    if not n:
        raise ValueError("no party has rows")
    mean = total[:-1] / n
    return n, mean, float(_summed(frame, lambda z, x: z + ((x - mean) ** 2).sum(), np.zeros(1))[0])


def subspace_iteration(frame: DataFrame, k: int, max_iter: int = 100, tol: float = 1e-6, seed: int | None = None, stats: DataFrame | None = None, matrix_dims: int = MATRIX_DIMS) -> PCAModel:
    """Orthogonal iteration from a seeded start until the projector moves less than tol in Frobenius norm.

    Eigenvalues are |R_ii| / N. info holds iterations, converged, history and the change at the end.
    """
    d, held = dimension(frame), None
    if d > matrix_dims:
        held = frame.select("features").persist(StorageLevel.MEMORY_AND_DISK)
        n, mean, spread = plain_moments(held, d)
    else:
        moments = pooled_moments(stats if stats is not None else party_stats(frame, d))
        n, mean, spread = moments.n, moments.mean, moments.m2.trace()
    k = min(k, d)
    v, _ = np.linalg.qr(np.random.RandomState(seed).randn(d, k))
    history, change, r = [], float("inf"), np.eye(k)
    for _ in range(max_iter):
        z = moments.m2 @ v if held is None else _product(held, mean, v)
        new, r = np.linalg.qr(z)
        change = float(np.sqrt(2) * np.linalg.norm(new - v @ (v.T @ new)))
        history.append(change)
        v = new
        if change < tol:
            break
    if held is not None:
        held.unpersist()
    values = np.abs(np.diag(r)) / n
    order = np.argsort(values)[::-1]
    return PCAModel.build(canonical(v.T[order]), mean, values[order], spread / n, n, iterations=len(history), converged=change < tol, change=change, history=history)

"""Policies that combine parties' statistics into one model, each a sum of d x d matrices.

A policy maps a party's (n, mean, covariance) to a weight and a symmetric matrix on the executors;
tasks sum what they map, a tree of bounded fan-in merges the sums, and the driver receives one
matrix whatever the number of parties and tasks. Stacked payloads (AP-STACK, QR-PCA) are combined through
the Gram matrix of the stack, whose eigenvectors are the stack's left singular vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .linalg import canonical, eigen_desc, pack, unpack
from .model import PCAModel
from .stats import Moments, merge_moments, merge_tree, moments_row, tasks_of

#: From one party to (scalars, vector, symmetric matrix), which are summed.
Part = Callable[[Moments], tuple[list[float], np.ndarray, np.ndarray]]


def _rows(pdf: pd.DataFrame) -> Iterator[Moments]:
    for n, mean, m2 in zip(pdf["n"], pdf["mean"], pdf["m2"]):
        mean = np.asarray(mean, float)
        yield Moments(int(n), mean, unpack(np.asarray(m2, float), len(mean)))


def sum_over(stats: DataFrame, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of part() over the parties."""
    schema = "task int, s array<double>, v array<double>, m array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            for x in _rows(pdf):
                if x.n:
                    got = [np.asarray(p, float) for p in part(x)]
                    total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "s": [total[0]], "v": [total[1]], "m": [pack(total[2])]})

    def merge(held: dict | None, r: pd.Series) -> dict:
        own = {c: np.asarray(r[c], float) for c in "svm"}
        return own if held is None else {c: held[c] + own[c] for c in "svm"}

    rows = merge_tree(stats.select("n", "mean", "m2").mapInPandas(run, schema), [], merge, lambda held: held, tasks_of(stats)).collect()
    if not rows:
        raise ValueError("no party has rows")
    s, v, m = (np.array(rows[0][c], float) for c in "svm")
    return s, v, unpack(m, len(v))


def pooled_moments(stats: DataFrame) -> Moments:
    """The moments of all parties' rows together, merged pairwise on the executors."""
    schema = "n long, mean array<double>, m2 array<double>, task int"

    def fold(frames: Iterator[pd.DataFrame]) -> Moments | None:
        total = None
        for pdf in frames:
            for x in _rows(pdf):
                total = x if total is None else total.merge(x)
        return total

    def frame(m: Moments) -> pd.DataFrame:
        return pd.DataFrame({"n": [m.n], "mean": [m.mean], "m2": [pack(m.m2)], "task": [TaskContext.get().partitionId()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (m := fold(frames)) is not None:
            yield frame(m)

    near = stats.select("n", "mean", "m2").mapInPandas(run, schema)
    rows = merge_tree(near, [], merge_moments, moments_row, tasks_of(stats)).collect()
    total = merge_moments(None, rows[0]) if rows else None
    if total is None or not total.n:
        raise ValueError("no party has rows")
    return total


def from_covariance(mean: np.ndarray, cov: np.ndarray, k: int, n: int, total: float | None = None) -> PCAModel:
    values, rows = eigen_desc(cov, k)
    return PCAModel.build(rows, mean, values[: len(rows)], float(values.sum()) if total is None else total, n)


def pcov(stats: DataFrame, k: int) -> PCAModel:
    """Exact: the pooled covariance, with the spread of the parties' means."""
    m = pooled_moments(stats)
    return from_covariance(m.mean, m.cov, k, m.n)


def apcov(stats: DataFrame, k: int, weighted: bool = True) -> PCAModel:
    """The mean of the parties' covariances, by rows or equal, without the spread of their means."""
    (n, parties, w), mean, cov = sum_over(stats, lambda x: ([x.n, 1, x.n if weighted else 1], x.n * x.mean, (x.n if weighted else 1) * x.cov))
    return from_covariance(mean / n, cov / w, k, int(n))


def _local_axes(x: Moments, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Local principal axes (rows) and the singular values of the centred rows."""
    values, rows = eigen_desc(x.m2, min(r, x.n, len(x.mean)))
    return rows, np.sqrt(np.maximum(values[: len(rows)], 0))


def apstack(stats: DataFrame, k: int, local: int | None = None) -> PCAModel:
    """Stack of local axes: weights are singular values where a party has fewer rows than features, else their square roots of eigenvalues."""
    r = local or k

    def part(x: Moments):
        rows, s = _local_axes(x, r)
        w = s if x.n < len(x.mean) else s / np.sqrt(x.n)
        return [x.n, 1, float(np.trace(x.m2))], x.n * x.mean, (rows * (w * w)[:, None]).T @ rows

    (n, parties, _), mean, gram = sum_over(stats, part)
    values, rows = eigen_desc(gram, k)
    values = np.maximum(values[: len(rows)], 0) / parties
    return PCAModel.build(rows, mean / n, values, pooled_moments(stats).m2.trace() / n, int(n))


def qr(stats: DataFrame, k: int, local: int | None = None, weighting: str = "reference") -> PCAModel:
    """Stack of local factors about the global mean.

    The factors hold the local singular values times sqrt(n_k / N) (`reference`), which is exact for
    equal parties only, or unweighted (`exact`), whose eigenvalues are the pooled ones.
    """
    if weighting not in ("reference", "exact"):
        raise ValueError("weighting must be 'reference' or 'exact'")
    whole = pooled_moments(stats)
    mu, total, most = whole.mean, whole.n, local or 2 * k

    def part(x: Moments):
        delta = x.mean - mu
        gram = x.m2 + x.n * np.outer(delta, delta)
        values, rows = eigen_desc(gram, max(0, min(most, x.n - 1, len(mu))))
        w = np.maximum(values[: len(rows)], 0) * (x.n / total if weighting == "reference" else 1.0)
        return [x.n], x.mean, (rows * w[:, None]).T @ rows

    _, _, gram = sum_over(stats, part)
    values, rows = eigen_desc(gram, k)
    return PCAModel.build(rows, mu, np.maximum(values[: len(rows)], 0) / total, whole.m2.trace() / total, total)


__all__ = ["apcov", "apstack", "canonical", "from_covariance", "pcov", "pooled_moments", "qr", "sum_over"]

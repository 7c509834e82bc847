"""Support vector machine with an RBF kernel, exact, for training sets of a bounded size.

One machine for each pair of classes, solved in its dual by sequential minimal optimisation with
second-order choice of the working pair; pairs are solved on the executors, a task each, and vote.
Training rows travel with the tasks, so their size is checked first (fits()).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of training rows that travel with a task, and rows of a pair of classes, whose kernel matrix one task holds.
TRAIN_BYTES, PAIR_ROWS = 64 << 20, 4000


def fits(train: DataFrame, column: str) -> bool:
    """Whether an exact machine can be trained: from counts alone."""
    got = [(r["n"], r["d"]) for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("d")).orderBy(F.desc("n")).limit(1001).collect()]
    rows = sum(n for n, _ in got)
    return len(got) <= 1000 and sum(n for n, _ in got[:2]) <= PAIR_ROWS and rows * max((d for _, d in got), default=0) * 8 <= TRAIN_BYTES


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def solve(kernel: np.ndarray, y: np.ndarray, c: float, tol: float = 1e-3, max_iter: int = 1_000_000) -> tuple[np.ndarray, float]:
    """(alpha, rho) of min a'Qa / 2 - sum a, 0 <= a <= c, y'a = 0, with Q = yy' * kernel; the margin is sum(a y K) - rho."""
    n = len(y)
    a, g, diag = np.zeros(n), -np.ones(n), np.diag(kernel).copy()
    for _ in range(max_iter):
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        v = -y * g
        i = int(np.argmax(np.where(up, v, -np.inf)))
        gain = np.where(low & (v < v[i]), v[i] - v, 0.0)
        if gain.max() < tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * kernel[i], 1e-12)
        j = int(np.argmax(gain * gain / curve))
        step = gain[j] / curve[j]
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * step * (kernel[i] - kernel[j])
    free = (a > 1e-12) & (a < c - 1e-12)
    v = y * g
    if free.any():
        return a, float(v[free].mean())
    up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
    return a, float((v[up].min() + v[~up].max()) / 2) if up.any() and not up.all() else 0.0


def predict_rbf(train: DataFrame, test: DataFrame, column: str, c: float, gamma: float, tol: float = 1e-3) -> DataFrame:
    """(row_id, predicted) by the votes of one machine for each pair of classes; a tied vote goes to the smallest class."""
    spark = train.sparkSession
    rows = train.where("label is not null").select("label", "row_id", F.col(column).cast("array<double>").alias("x")).toPandas().sort_values(["label", "row_id"], kind="stable")
    x, label = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(np.int64)
    classes = np.unique(label)
    pairs = list(combinations(range(len(classes)), 2))

    def machines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p in pdf["id"]:
                first, second = (classes[k] for k in pairs[p])
                at = np.flatnonzero((label == first) | (label == second))
                y = np.where(label[at] == first, 1.0, -1.0)
                a, rho = solve(rbf(x[at], x[at], gamma), y, c, tol)
                yield pd.DataFrame({"pair": [p], "rho": [rho], "coef": [(a * y).tolist()]})

    found = spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInPandas(machines, "pair long, rho double, coef array<double>").collect()
    coef, rho = np.zeros((len(x), len(pairs))), np.zeros(len(pairs))
    for r in found:
        first, second = (classes[k] for k in pairs[r["pair"]])
        coef[(label == first) | (label == second), r["pair"]] = r["coef"]
        rho[r["pair"]] = r["rho"]

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                margin = rbf(np.stack(part["x"].to_numpy()), x, gamma) @ coef - rho
                votes = np.zeros((len(part), len(classes)), int)
                for p, (i, j) in enumerate(pairs):
                    votes[:, i] += margin[:, p] > 0
                    votes[:, j] += margin[:, p] <= 0
                yield pd.DataFrame({"row_id": part["row_id"], "predicted": classes[votes.argmax(axis=1)].astype(np.int32)})

    return test.select("row_id", F.col(column).cast("array<double>").alias("x")).mapInPandas(vote, "row_id long, predicted int")

"""Classification on projected data: k nearest neighbours, logistic regression, an RBF machine.

Nearest neighbours are exact: training rows are cut into blocks of bounded size, every task scans
its test rows against one block and keeps k candidates a row, and candidates of all blocks merge by
rank. Neither side is collected whole anywhere, and no pair of rows is materialised. The RBF machine
is exact (kernel.py) where its training rows fit a task, and approximate beyond: one-vs-rest linear
machines on random Fourier features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import fits, predict_rbf

TRAIN_BLOCK, TEST_BLOCK = 4096, 2048
#: Pairs measured exactly at once.
PAIRS = 1 << 16


def _blocked(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """df with its block, and how many there are. Blocks are int, like sequence()'s: cogrouped keys of two types hash apart and never meet."""
    n = max(1, -(-df.count() // size))
    return df.withColumn(name, F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")), n


def _apart(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances row by row, squares summed in the order of the values, as SQL's list_distance does: what ties there ties here."""
    far = np.zeros(len(y))
    for a, b in zip(y.T, x.T):
        far += (a - b) ** 2
    return np.sqrt(far)


def nearest(train: DataFrame, test: DataFrame, k: int, column: str = "features") -> DataFrame:
    """(row_id, neighbour, label, distance, rank): the k nearest training rows of each test row; ties by neighbour id, NaN last (as null)."""
    a, na = _blocked(train.select("row_id", "label", F.col(column).alias("x")), "a", TRAIN_BLOCK)
    b, nb = _blocked(test.select("row_id", F.col(column).alias("x")), "b", TEST_BLOCK)
    a = a.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    b = b.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))
    cell = ["a", "b"]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row_id": [], "neighbour": [], "label": [], "distance": []})
        left = left.sort_values("row_id")
        x, y = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        most = min(k, len(x))
        with np.errstate(over="ignore", invalid="ignore"):
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            far = np.maximum(yy[:, None] - 2 * y @ x.T + xx[None, :], 0)
            # products round: whatever could still be among the k nearest is measured exactly, ties all of them
            slack = 1e-12 * x.shape[1] * (yy + xx[np.isfinite(xx)].max(initial=0))
            vague = ~np.isfinite(far)  # overflow, infinite values and NaN say nothing
            far[vague] = np.inf
            near = vague | (far <= (np.partition(far, most - 1, axis=1)[:, most - 1] + 2 * slack)[:, None])
        parts = []
        for s in range(0, len(y), 64):
            i, j = np.nonzero(near[s : s + 64])
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.concatenate([_apart(y[s + i[q : q + PAIRS]], x[j[q : q + PAIRS]]) for q in range(0, len(i), PAIRS)])
            order = np.lexsort((j, exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < most
            parts.append((s + i[keep], j[keep], exact[keep]))
        i, j, exact = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame({"row_id": right["row_id"].to_numpy()[i], "neighbour": left["row_id"].to_numpy()[j], "label": left["label"].to_numpy()[j], "distance": exact})

    found = a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(scan, "row_id long, neighbour long, label int, distance double")
    w = Window.partitionBy("row_id").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, column: str = "features") -> DataFrame:
    """(row_id, predicted) by majority of the k nearest; a tied vote goes to the smallest label."""
    votes = nearest(train, test, k, column).groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("row_id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("predicted"))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row from (label, predicted): accuracy, and precision, recall and F1 weighted by class size, 0 where undefined."""
    cells = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    true = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    c = true.join(said, "label", "left").withColumn("p", F.coalesce(F.col("hit") / F.col("said"), F.lit(0.0))).withColumn("r", F.col("hit") / F.col("support"))
    c = c.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    mean = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return c.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def _ml(df: DataFrame, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select("row_id", "label", array_to_vector(F.col(column).cast("array<double>")).alias("x"))


def _fourier(df: DataFrame, column: str, gamma: float, width: int, seed: int) -> DataFrame:
    """Random Fourier features of an RBF kernel."""
    d = df.select(F.size(column)).first()[0]
    rng = np.random.RandomState(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (d, width)), rng.uniform(0, 2 * np.pi, width)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                z = np.sqrt(2 / width) * np.cos(np.stack(pdf["x"].to_numpy()) @ w + b)
                yield pd.DataFrame({"row_id": pdf["row_id"], "label": pdf["label"], "features": list(z)})

    return df.select("row_id", "label", F.col(column).cast("array<double>").alias("x")).mapInPandas(run, "row_id long, label int, features array<double>")


def predict(train: DataFrame, test: DataFrame, classifier: str = "knn", column: str = "features", k: int = 5, c: float = 1.0, max_iter: int = 1000, width: int = 512, seed: int = 0, exact: bool | None = None) -> DataFrame:
    """(row_id, label, predicted) of test rows by `knn`, `logistic` or `svm`.

    The SVM is exact where kernel.fits() (or `exact`) says so; width, seed and max_iter are the approximation's.
    """
    if classifier == "knn":
        got = knn_predict(train, test, k, column)
    elif classifier == "svm" and (fits(train, column) if exact is None else exact):
        got = predict_rbf(train, test, column, c, 1.0 / _scale(train, column))
    elif classifier in ("logistic", "svm"):
        from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest

        if classifier == "svm":
            gamma = 1.0 / _scale(train, column)
            train, test, column = _fourier(train, column, gamma, width, seed), _fourier(test, column, gamma, width, seed), "features"
        n = train.count()
        if classifier == "logistic":
            made = LogisticRegression(featuresCol="x", maxIter=max_iter, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False)
        else:
            made = OneVsRest(featuresCol="x", classifier=LinearSVC(featuresCol="x", maxIter=max_iter, regParam=1 / (c * n), standardization=False))
        model = made.fit(_ml(train, column).withColumn("label", F.col("label").cast("double")))
        got = model.transform(_ml(test, column).drop("label")).select("row_id", F.col("prediction").cast("int").alias("predicted"))
    else:
        raise ValueError(f"unknown classifier {classifier!r}; known: knn, svm, logistic")
    return test.select("row_id", "label").join(got, "row_id")


def _scale(train: DataFrame, column: str) -> float:
    """Features times the variance of all values: the kernel width that scales with the data."""
    x = train.select(F.size(column).alias("d"), F.explode(column).alias("v")).agg(F.max("d"), F.var_pop("v")).first()
    return float(x[0] * x[1]) or 1.0


def evaluate_classification(train: DataFrame, test: DataFrame, classifier: str = "knn", column: str = "features", **params) -> DataFrame:
    return classification_metrics(predict(train, test, classifier, column, **params))


def compare_classification(train_a: DataFrame, test_a: DataFrame, train_b: DataFrame, test_b: DataFrame, classifier: str = "knn", **params) -> DataFrame:
    """One row: accuracy and F1 of both representations, and b's less a's."""
    a, b = evaluate_classification(train_a, test_a, classifier, **params), evaluate_classification(train_b, test_b, classifier, **params)
    both = a.select(F.col("accuracy").alias("accuracy_a"), F.col("f1").alias("f1_a")).join(b.select(F.col("accuracy").alias("accuracy_b"), F.col("f1").alias("f1_b")))
    return both.withColumn("accuracy_difference", F.col("accuracy_b") - F.col("accuracy_a")).withColumn("f1_difference", F.col("f1_b") - F.col("f1_a"))

"""Experiments: one scorecard a method, sweeps over configurations, summaries, and frames to plot."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.combine import pooled_moments
from ..operators.downstream import evaluate_classification
from ..operators.estimators import METHODS, estimator
from ..operators.model import PCAModel
from ..operators.stats import party_stats
from ..sources.partition import DataPartitioner

SCORECARD = "method string, n_components int, fit_seconds double, mean_angle double, max_angle double, alignment double, reconstruction_mse double, explained double, accuracy double, rounds int, total_bytes long"


def scorecard(spark: SparkSession, train: DataFrame, test: DataFrame | None, k: int, methods: list[str] | None = None, seed: int = 42, classify: bool = True) -> DataFrame:
    """A row for each method: time, angles to the pooled model, reconstruction, variance, nearest-neighbour accuracy, traffic.

    The statistics table is computed once and shared; training rows are scanned again only to
    classify. Reconstruction error on the training rows follows from the statistics. accuracy is
    null without test rows.
    """
    stats = party_stats(train).persist(StorageLevel.MEMORY_AND_DISK)
    whole, truth, rows = pooled_moments(stats), estimator("P-COV", k, seed).fit(train, stats).model, []
    for name in methods or list(METHODS):
        began = time.time()
        est = estimator(name, k, seed).fit(train, stats)
        took, model = time.time() - began, est.model
        angles = np.degrees(metrics.principal_angles(truth.components, model.components))
        accuracy = None
        if classify and test is not None:
            accuracy = float(evaluate_classification(est.transform(train), est.transform(test), column="scores").first()["accuracy"])
        cost = est.communication_cost()
        rows.append((name, k, took, float(angles.mean()), float(angles.max()), metrics.alignment_score(truth.components, model.components), metrics.mse_from_moments(whole, model), float(metrics.explained_variance_ratio(model).sum()), accuracy, cost["rounds"], cost["total_bytes"]))
    stats.unpersist()
    return spark.createDataFrame(rows, SCORECARD)


@dataclass(frozen=True)
class Config:
    partition: str
    params: tuple[tuple[str, float], ...]
    num_clients: int
    n_components: int


def grid(spark: SparkSession, partitions: list[tuple[str, dict]], clients: list[int], components: list[int]) -> DataFrame:
    """All combinations but the largest of both (50 parties with 50 components), as rows."""
    parts = spark.createDataFrame([(p, float(d.get("alpha", d.get("power", 0.0)))) for p, d in partitions], "partition string, parameter double").coalesce(1)
    wide = parts.withColumn("num_clients", F.explode(F.array(*map(F.lit, clients)))).withColumn("n_components", F.explode(F.array(*map(F.lit, components))))
    return wide.where("not (num_clients = 50 and n_components = 50)")


def sweep(spark: SparkSession, data: DataFrame, partitions: list[tuple[str, dict]], clients: list[int], components: list[int], methods: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Scorecards (without classification) of every configuration of grid()."""
    out = None
    for r in grid(spark, partitions, clients, components).collect():
        params = dict(next(d for p, d in partitions if p == r["partition"] and float(d.get("alpha", d.get("power", 0.0))) == r["parameter"]))
        parted = DataPartitioner(r["num_clients"], seed).partition(data, r["partition"], **params)
        card = scorecard(spark, parted, None, r["n_components"], methods, seed)
        card = card.withColumn("partition", F.lit(r["partition"])).withColumn("parameter", F.lit(r["parameter"])).withColumn("num_clients", F.lit(r["num_clients"]))
        out = card if out is None else out.unionByName(card)
    return out


def summary(results: DataFrame, partition: str | None = None, sort: str = "num_clients") -> DataFrame:
    rows = results if partition is None else results.where(F.col("partition") == partition)
    return rows.orderBy(sort, "method")


def best_method(results: DataFrame, by: list[str], metric: str = "mean_angle", tolerance: float = 0.1) -> DataFrame:
    """by, best (lowest metric), value, and whether each method comes within tolerance of it."""
    best = results.groupBy(*by).agg(F.min_by("method", F.struct(metric, "method")).alias("best"), F.min(metric).alias("value"))
    return results.join(best, by).withColumn("matches", F.abs(F.col(metric) - F.col("value")) < tolerance).select(*by, "method", metric, "best", "value", "matches")


def method_pivot(results: DataFrame, by: str, metric: str, methods: list[str] | None = None) -> DataFrame:
    """A row for each value of by, a column for each method: what a grouped bar chart or a heat map shows."""
    return results.groupBy(by).pivot("method", methods).agg(F.first(metric)).orderBy(by)


def variance_curves(spark: SparkSession, models: dict[str, PCAModel]) -> DataFrame:
    """(method, idx, cumulative) of explained variance."""
    out = None
    for name, m in models.items():
        f = m.frame(spark).select(F.lit(name).alias("method"), "idx", "ratio")
        out = f if out is None else out.unionByName(f)
    w = Window.partitionBy("method").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("method", "idx", F.sum("ratio").over(w).alias("cumulative"))


def angle_bars(spark: SparkSession, truth: PCAModel, models: dict[str, PCAModel]) -> DataFrame:
    """(method, idx, angle) in degrees."""
    rows = [(n, i, float(a)) for n, m in models.items() for i, a in enumerate(np.degrees(metrics.principal_angles(truth.components, m.components)))]
    return spark.createDataFrame(rows, "method string, idx int, angle double")


def projections(data: DataFrame, models: dict[str, PCAModel]) -> DataFrame:
    """(row_id, label, method, pc1, pc2): points of a scatter of each model's first two components."""
    out = None
    for name, m in models.items():
        f = m.transform(data).select("row_id", "label", F.lit(name).alias("method"), F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"))
        out = f if out is None else out.unionByName(f)
    return out


def metric_bars(results: DataFrame, metric: str = "reconstruction_mse") -> DataFrame:
    """(method, value): one bar a method, over all configurations the mean."""
    return results.groupBy("method").agg(F.avg(metric).alias("value"))


def robustness(results: DataFrame, metric: str = "mean_angle", by: str = "parameter", partition: str | None = "dirichlet") -> DataFrame:
    """(by, method, value) in order: a line a method against the skew of the partition."""
    rows = results if partition is None else results.where(F.col("partition") == partition)
    return rows.groupBy(by, "method").agg(F.avg(metric).alias("value")).orderBy(by, "method")


def scalability(results: DataFrame, metric: str = "mean_angle") -> DataFrame:
    """(num_clients, method, value) in order: a line a method against the number of parties."""
    return robustness(results, metric, "num_clients", None)


class Projection:
    """A model's scores of a frame, computed once: head() and points() read the held rows until release()."""

    def __init__(self, model: PCAModel, data: DataFrame):
        self.model = model
        self.scores = model.transform(data).persist(StorageLevel.MEMORY_AND_DISK)

    def points(self, first: int = 0, second: int = 1) -> DataFrame:
        return self.scores.select("row_id", "label", F.col("scores")[first].alias("x"), F.col("scores")[second].alias("y"))

    def release(self) -> None:
        self.scores.unpersist()


#: Rows that a chart draws at most; a larger frame is an error, as the driver draws.
DRAWN = 100_000


def render(frame: DataFrame, path: str, x: str, y: str, series: str = "method", kind: str = "line") -> None:
    """Draw a frame of at most DRAWN rows where matplotlib is installed: `line`, `scatter`, `bar` or `heat`."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = frame.limit(DRAWN + 1).toPandas()
    if len(rows) > DRAWN:
        raise ValueError(f"more than {DRAWN} rows to draw")
    draw_chart(plt, rows, path, x, y, series, kind)


def draw_chart(plt, rows, path: str, x: str, y: str, series: str, kind: str) -> None:
    """The chart itself; plt is matplotlib's pyplot or what stands in for it."""
    if kind not in ("line", "scatter", "bar", "heat"):
        raise ValueError(f"unknown kind {kind!r}")
    fig, ax = plt.subplots()
    if kind == "heat":
        grid_ = rows.pivot(index=x, columns=series, values=y)
        fig.colorbar(ax.imshow(grid_.to_numpy(), aspect="auto"))
        ax.set_xticks(range(len(grid_.columns)), list(grid_.columns))
        ax.set_yticks(range(len(grid_.index)), list(grid_.index))
    elif kind == "bar":  # grouped: the series side by side at each x
        names, places = sorted(rows[series].unique()), list(dict.fromkeys(rows[x]))
        for k, name in enumerate(names):
            part = rows[rows[series] == name]
            ax.bar([places.index(v) + (k - (len(names) - 1) / 2) * 0.8 / len(names) for v in part[x]], part[y], 0.8 / len(names), label=str(name).replace("_", " ").title())
        ax.set_xticks(range(len(places)), [str(p) for p in places])
        ax.legend()
    else:
        for name, part in rows.sort_values(x).groupby(series):
            (ax.plot if kind == "line" else ax.scatter)(part[x], part[y], label=str(name).replace("_", " ").title())
        ax.legend()
    ax.set_xlabel(x if kind != "heat" else series)
    ax.set_ylabel(y if kind != "heat" else x)
    fig.savefig(path, dpi=150)
    plt.close(fig)


def bandwidth(d: int = 3072, ranks: tuple[int, ...] = (100, 200), bits: tuple[int, ...] = (8, 16)) -> list[tuple[str, float, float]]:
    """(method, megabytes, savings in percent) of one party's covariance message."""
    full = 8.0 * d * d
    rows = [("full", full)] + [(f"low_rank_{k}", 8.0 * (d * k + k + 1)) for k in ranks] + [(f"quantize_{b}", d * d * b / 8.0) for b in bits]
    return [(m, b / 1e6, 100 * (1 - b / full)) for m, b in rows]

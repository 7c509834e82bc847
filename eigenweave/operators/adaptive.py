"""Measure how far parties' data differ, and choose the combination policy by it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .combine import sum_over
from .estimators import AveragedCovariance, Estimator, PooledCovariance, StackedAxes, estimator
from .model import PCAModel
from .stats import Moments

#: Weights and gains of the score's parts, limits of its levels.
WEIGHTS = {"mean_divergence_normalized": (0.25, 3.0), "cov_divergence_normalized": (0.45, 1.5), "spectrum_divergence": (0.20, 10.0), "variance_divergence": (0.10, 5.0)}
LOW, HIGH = 0.15, 0.35


def level(score: float) -> str:
    return "low" if score < LOW else "medium" if score < HIGH else "high"


def score(metrics: dict[str, float]) -> float:
    return min(1.0, sum(w * min(1.0, g * metrics[m]) for m, (w, g) in WEIGHTS.items()))


def _spectrum(x: Moments, most: int, length: int | None = None) -> np.ndarray:
    values = np.linalg.eigvalsh(x.cov)[::-1][: min(most, min(x.n, len(x.mean)) - 1)]
    values = np.maximum(values, 0) if length is None else np.maximum(values[:length], 0)
    return values


def heterogeneity(stats: DataFrame, n_eigen: int = 50) -> dict:
    """Metrics, score and level of a statistics table, in two passes of fixed-size sums over its parties.

    Averages weigh parties by rows, spectra are compared unweighted by Kullback-Leibler divergence
    from their mean, after cutting to the shortest one.
    """
    stats = stats.where("n > 0")
    first = lambda x: ([x.n, 1, x.n * float(np.trace(x.cov)), x.n * x.n], x.n * x.mean, x.n * x.cov)
    (n, parties, trace, squares), mean, cov = sum_over(stats, first)
    mean, cov, trace, d = mean / n, cov / n, trace / n, len(mean)
    low, high, short = stats.selectExpr("min(n)", "max(n)", f"min(least({n_eigen}, least(n, size(mean)) - 1))").first()
    short = max(short, 0)

    def spread(x: Moments):
        values = _spectrum(x, n_eigen, short)
        norm = values / (values.sum() + 1e-8) if short else np.zeros(0)
        far = float(np.linalg.norm(x.mean - mean))
        spec = np.zeros(d)
        spec[:short] = norm
        own = [x.n * far, x.n * float(np.linalg.norm(x.cov - cov)), x.n * abs(float(np.trace(x.cov)) - trace) / (trace + 1e-8)]
        return own, spec, np.zeros((d, d))

    (far, cov_far, var_far), spec, _ = sum_over(stats, spread)
    spec = spec[:short] / parties

    def diverge(x: Moments):
        values = _spectrum(x, n_eigen, short)
        p = values / (values.sum() + 1e-8) + 1e-10
        kl = float(np.sum(p * np.log(p / (spec + 1e-10)))) if short else 0.0
        return [kl], np.zeros(d), np.zeros((d, d))

    (kl,), _, _ = sum_over(stats, diverge)
    metrics = {
        "mean_divergence": far / n,
        "mean_divergence_max": _farthest(stats, mean),
        "mean_divergence_normalized": far / n / (np.sqrt(trace / d + 1e-8) * np.sqrt(d)),
        "cov_divergence": cov_far / n,
        "cov_divergence_normalized": cov_far / n / (float(np.linalg.norm(cov)) + 1e-8),
        "sample_cv": float(np.sqrt(max(0.0, squares / parties - (n / parties) ** 2)) / (n / parties)),
        "sample_imbalance": high / (low + 1),
        "spectrum_divergence": kl / parties,
        "variance_divergence": var_far / n,
    }
    metrics = {k: float(v) for k, v in metrics.items()}
    s = score(metrics)
    return {"metrics": metrics, "score": s, "level": level(s), "n_parties": int(parties), "n_samples": int(n)}


def _farthest(stats: DataFrame, mean: np.ndarray) -> float:
    centre = F.array(*(F.lit(float(m)) for m in mean))
    square = F.aggregate(F.zip_with("mean", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return float(stats.agg(F.max(F.sqrt(square))).first()[0])


@dataclass
class Adaptive(Estimator):
    """P-COV where heterogeneity is high, weighted AP-COV below, or a forced method; one statistics table serves both steps."""

    force_method: str | None = None
    name = "Adaptive"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.force_method not in (None, "P-COV", "AP-COV", "AP-STACK"):
            raise ValueError(f"unknown method {self.force_method!r}")
        self.detected: dict | None = None
        self.chosen: Estimator | None = None

    def _fit(self, samples: DataFrame, stats: DataFrame) -> PCAModel:
        self.detected = heterogeneity(stats, min(self.n_components, 50))
        name = self.force_method or (PooledCovariance.name if self.detected["score"] >= HIGH else AveragedCovariance.name)
        kind = {c.name: c for c in (PooledCovariance, AveragedCovariance, StackedAxes)}[name]
        self.chosen = kind(self.n_components, self.random_state).fit(samples, stats)
        return self.chosen.model

    def communication_cost(self) -> dict:
        self.model  # noqa: B018
        return self.chosen.communication_cost()

    def selection_report(self) -> str:
        self.model  # noqa: B018
        found, why = self.detected, "forced by the caller" if self.force_method else self.reason()
        lines = [f"heterogeneity {found['level']} (score {found['score']:.4f}) over {found['n_parties']} parties, {found['n_samples']} rows", f"method {self.chosen.name}: {why}"]
        return "\n".join(lines + [f"  {k}: {v:.6f}" for k, v in found["metrics"].items()])

    def reason(self) -> str:
        return {"low": "parties look alike, one round without means suffices", "medium": "moderate differences, averaging by rows is close enough", "high": "parties differ, the spread of their means must be pooled"}[self.detected["level"]]


def evaluate_selection(spark, samples: DataFrame, stats: DataFrame, k: int = 20, seed: int | None = 42) -> DataFrame:
    """(method, mean_angle, max_angle) in degrees to the pooled model, all fitted from one statistics table."""
    from . import metrics

    truth = estimator("P-COV", k, seed).fit(samples, stats).model
    rows = []
    for name, est in {"Adaptive": Adaptive(k, seed), **{m: estimator(m, k, seed) for m in ("P-COV", "AP-COV", "AP-STACK")}}.items():
        angles = np.degrees(metrics.principal_angles(truth.components, est.fit(samples, stats).model.components))
        rows.append((name, float(angles.mean()), float(angles.max())))
    return spark.createDataFrame(rows, "method string, mean_angle double, max_angle double")

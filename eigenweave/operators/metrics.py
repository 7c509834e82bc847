"""Scores of a model: subspace alignment, reconstruction, variance.

Subspace metrics are driver arithmetic on two k x d models. Reconstruction and variance metrics run
as one aggregation over rows, or with no scan at all from a statistics table: the moments of
projected data follow from the moments of the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import PCAModel
from .stats import Moments

TINY = 1e-10


def _basis(v: np.ndarray) -> np.ndarray:
    v = np.atleast_2d(np.asarray(v, float))
    return np.linalg.qr(v.T if v.shape[0] < v.shape[1] else v)[0]


def principal_angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Angles in radians, rising, between the spans of two sets of components (rows or columns, whichever is the longer side's).

    Small angles come from the sine, which resolves them to rounding, large ones from the cosine.
    """
    qu, qv = _basis(u), _basis(v)
    cos = np.clip(np.linalg.svd(qu.T @ qv, compute_uv=False), 0, 1)
    narrow, wide = (qu, qv) if qu.shape[1] <= qv.shape[1] else (qv, qu)
    sin = np.clip(np.linalg.svd(narrow - wide @ (wide.T @ narrow), compute_uv=False)[::-1], 0, 1)
    return np.sort(np.where(cos > 0.9, np.arcsin(sin[: len(cos)]), np.arccos(cos)))


def subspace_distance(u: np.ndarray, v: np.ndarray, metric: str = "grassmann") -> float:
    angles = principal_angles(u, v)
    if metric == "grassmann":
        return float(np.linalg.norm(angles))
    if metric == "chordal":
        return float(np.linalg.norm(np.sin(angles)))
    if metric == "projection":
        return float(np.sin(angles.max()))
    if metric == "mean_angle":
        return float(angles.mean())
    raise ValueError(f"unknown metric {metric!r}")


def alignment_score(u: np.ndarray, v: np.ndarray) -> float:
    return float(np.cos(principal_angles(u, v)).mean())


def component_correlation(u: np.ndarray, v: np.ndarray, match_sign: bool = True) -> np.ndarray:
    """Cosine of each pair of components with the same index."""
    k = min(len(u), len(v))
    dots = np.einsum("ij,ij->i", u[:k], v[:k]) / (np.linalg.norm(u[:k], axis=1) * np.linalg.norm(v[:k], axis=1) + TINY)
    return np.abs(dots) if match_sign else dots


def subspace_overlap(u: np.ndarray, v: np.ndarray) -> float:
    """Share of u's squared norm that lies in the span of v's (orthonormal) rows."""
    return float(np.linalg.norm(u @ v.T) ** 2 / (np.linalg.norm(u) ** 2 + TINY))


def degrees(angles: np.ndarray) -> np.ndarray:
    return np.degrees(angles)


def _restored(df: DataFrame, model: PCAModel, name: str = "restored") -> DataFrame:
    return model.inverse_transform(model.transform(df, "features", "__z"), "__z", name).drop("__z")


def _sum(column, f):
    return F.aggregate(F.transform(column, f), F.lit(0.0), lambda a, x: a + x)


def _residual(name: str = "restored"):
    return F.zip_with("features", F.col(name), lambda a, b: a - b)


def per_sample_error(df: DataFrame, model: PCAModel) -> DataFrame:
    """df with `error`: the mean squared difference of a row's values."""
    return _restored(df, model).withColumn("error", _sum(_residual(), lambda x: x * x) / F.size("features")).drop("restored")


def reconstruction_errors(df: DataFrame, model: PCAModel) -> DataFrame:
    """One row: mse, rmse and mae over all entries, and the relative Frobenius error."""
    rows = _restored(df, model).select(_sum(_residual(), lambda x: x * x).alias("sse"), _sum(_residual(), F.abs).alias("sae"), _sum(F.col("features"), lambda x: x * x).alias("ssx"), F.size("features").alias("d"))
    s = rows.agg(*(F.sum(c).alias(c) for c in ("sse", "sae", "ssx", "d")))
    mse = F.col("sse") / F.col("d")
    return s.select(mse.alias("mse"), F.sqrt(mse).alias("rmse"), (F.col("sae") / F.col("d")).alias("mae"), (F.sqrt("sse") / (F.sqrt("ssx") + TINY)).alias("relative_error"))


def reconstruction_error(df: DataFrame, model: PCAModel, metric: str = "mse") -> float:
    if metric not in ("mse", "rmse", "mae"):
        raise ValueError(f"unknown metric {metric!r}")
    return reconstruction_errors(df, model).first()[metric]


def reconstruction_error_ratio(df: DataFrame, model: PCAModel, baseline: PCAModel) -> DataFrame:
    """One row: model_mse, baseline_mse and their ratio, in one pass with both models."""
    both = _restored(_restored(df, model, "a"), baseline, "b")
    rows = both.select(_sum(_residual("a"), lambda x: x * x).alias("a"), _sum(_residual("b"), lambda x: x * x).alias("b"), F.size("features").alias("d"))
    s = rows.agg((F.sum("a") / F.sum("d")).alias("model_mse"), (F.sum("b") / F.sum("d")).alias("baseline_mse"))
    return s.withColumn("ratio", F.col("model_mse") / (F.col("baseline_mse") + TINY))


def projected(moments: Moments, model: PCAModel) -> Moments:
    """Moments of the projected rows, from those of the rows."""
    w = model.components
    return Moments(moments.n, w @ (moments.mean - model.mean), w @ moments.m2 @ w.T)


def mse_from_moments(moments: Moments, model: PCAModel) -> float:
    """Mean squared reconstruction error of the rows with these moments, for orthonormal components."""
    w, off = model.components, moments.mean - model.mean
    second = moments.cov + np.outer(off, off)
    return float((np.trace(second) - np.trace(w @ second @ w.T)) / len(off))


def variance_retention(moments: Moments, model: PCAModel) -> float:
    return float(np.trace(projected(moments, model).cov) / (np.trace(moments.cov) + TINY))


def explained_variance_ratio(model: PCAModel, moments: Moments | None = None, recompute: bool = False) -> np.ndarray:
    """The model's own ratios; of the rows with these moments if asked to recompute."""
    if moments is None or not recompute:
        return model.explained_variance_ratio
    return np.diag(projected(moments, model).cov) / (np.trace(moments.cov) + TINY)


def cumulative_variance(model_frame: DataFrame) -> DataFrame:
    """A model's frame with `cumulative`: the running sum of its ratios."""
    from pyspark.sql import Window

    return model_frame.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))


def compare_variance(a: PCAModel, b: PCAModel) -> dict:
    """Ratios and totals of two models, and how far the first k components' ratios are apart."""
    k = min(len(a.explained_variance), len(b.explained_variance))
    ra, rb = a.explained_variance_ratio, b.explained_variance_ratio
    diff = ra[:k] - rb[:k]
    return {"ratio_a": ra, "ratio_b": rb, "total_a": float(ra.sum()), "total_b": float(rb.sum()), "mean_abs_difference": float(np.abs(diff).mean()), "max_abs_difference": float(np.abs(diff).max())}

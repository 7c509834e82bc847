"""Compressed exchange of party covariances: low rank, sketch, quantised, largest entries, combined.

Each method maps a matrix to a payload and back, and states its size in values. On a statistics
table compression runs where the party's row is; quantisation and the largest entries are also
plain DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .combine import sum_over
from .estimators import Estimator
from .linalg import nearest_psd, pack, unpack
from .model import PCAModel
from .stats import Moments

METHODS = ("none", "low_rank", "sketch", "quantize", "top_k", "combined")
LEVELS = {8: 255, 16: 65535}


def original_size(d: int, include_mean: bool = True) -> int:
    """Values of a party's message: covariance, row count and, if included, mean."""
    return d * d + (d if include_mean else 0) + 1


@dataclass(frozen=True)
class LowRank:
    """Leading eigenpairs and the trace of the rest, which comes back as a multiple of the identity.

    residual `coordinate` takes it off the first k diagonal entries, `subspace` off the kept axes.
    """

    rank: int = 100
    residual: str = "coordinate"

    def compress(self, c: np.ndarray) -> dict:
        values, vectors = np.linalg.eigh(c)
        k = min(self.rank, len(c))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        return {"values": values, "vectors": vectors, "rest": float(np.trace(c) - values.sum())}

    def decompress(self, p: dict, d: int) -> np.ndarray:
        v, k = p["vectors"], len(p["values"])
        out = (v * p["values"]) @ v.T
        if k < d:
            share = p["rest"] / (d - k)
            out = out + share * np.eye(d) - share * (np.diag([1.0] * k + [0.0] * (d - k)) if self.residual == "coordinate" else v @ v.T)
        return out

    def size(self, d: int) -> int:
        k = min(self.rank, d)
        return d * k + k + 1


@dataclass(frozen=True)
class Sketch:
    """R C R' for a Gaussian R fixed by the seed; R' S R has C's eigenvectors in expectation, with a lifted spectrum."""

    width: int = 200
    seed: int = 42

    def matrix(self, d: int) -> np.ndarray:
        return np.random.RandomState(self.seed).randn(self.width, d) / np.sqrt(self.width)

    def compress(self, c: np.ndarray) -> dict:
        r = self.matrix(len(c))
        return {"sketch": r @ c @ r.T}

    def decompress(self, p: dict, d: int) -> np.ndarray:
        r = self.matrix(d)
        out = r.T @ p["sketch"] @ r
        return (out + out.T) / 2

    def size(self, d: int) -> int:
        return self.width**2


@dataclass(frozen=True)
class Quantize:
    """Min-max scaled unsigned integers of 8 or 16 bits, or 32-bit floats. rounding: `trunc` or `nearest`."""

    bits: int = 16
    rounding: str = "trunc"

    def __post_init__(self) -> None:
        if self.bits not in (8, 16, 32):
            raise ValueError("bits must be 8, 16 or 32")

    def compress(self, c: np.ndarray) -> dict:
        if self.bits == 32:
            return {"codes": c.astype(np.float32), "low": 0.0, "high": 1.0}
        low, high = float(c.min()), float(c.max())
        unit = (c - low) / (high - low) if high > low else np.zeros_like(c)
        codes = unit * LEVELS[self.bits]
        codes = np.rint(codes) if self.rounding == "nearest" else np.trunc(codes)
        return {"codes": codes.astype(np.uint8 if self.bits == 8 else np.uint16), "low": low, "high": high}

    def decompress(self, p: dict, d: int) -> np.ndarray:
        x = p["codes"].astype(float)
        return x if self.bits == 32 else x / LEVELS[self.bits] * (p["high"] - p["low"]) + p["low"]

    def size(self, d: int) -> int:
        return d * d


@dataclass(frozen=True)
class TopK:
    """The k upper-triangle entries of largest magnitude, and the whole diagonal."""

    k: int = 10_000

    def compress(self, c: np.ndarray) -> dict:
        i, j = np.triu_indices(len(c))
        value = c[i, j]
        top = np.argsort(-np.abs(value), kind="stable")[: self.k]
        return {"i": i[top], "j": j[top], "value": value[top], "diagonal": np.diag(c).copy()}

    def decompress(self, p: dict, d: int) -> np.ndarray:
        out = np.zeros((d, d))
        out[p["i"], p["j"]] = out[p["j"], p["i"]] = p["value"]
        out[np.arange(d), np.arange(d)] = p["diagonal"]
        return out

    def size(self, d: int) -> int:
        return 3 * min(self.k, d * (d + 1) // 2) + d


@dataclass(frozen=True)
class Combined:
    """Low rank, then quantised eigenvectors."""

    low: LowRank = LowRank()
    quantize: Quantize = Quantize()

    def compress(self, c: np.ndarray) -> dict:
        p = self.low.compress(c)
        return {**p, "vectors": self.quantize.compress(p["vectors"])}

    def decompress(self, p: dict, d: int) -> np.ndarray:
        return self.low.decompress({**p, "vectors": self.quantize.decompress(p["vectors"], d)}, d)

    def size(self, d: int) -> int:
        return self.low.size(d)


class Plain:
    def compress(self, c: np.ndarray) -> dict:
        return {"matrix": c}

    def decompress(self, p: dict, d: int) -> np.ndarray:
        return p["matrix"]

    def size(self, d: int) -> int:
        return d * d


def codec(method: str, rank: int = 100, sketch: int = 200, bits: int = 16, k: int = 10_000, seed: int = 42, residual: str = "coordinate", rounding: str = "trunc"):
    """(codec, bits of each value) of a method by name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    made = {"none": Plain(), "low_rank": LowRank(rank, residual), "sketch": Sketch(sketch, seed), "quantize": Quantize(bits, rounding), "top_k": TopK(k), "combined": Combined(LowRank(rank, residual), Quantize(bits, rounding))}[method]
    return made, bits if method in ("quantize", "combined") else 64


def compression_stats(method: str, d: int, **params) -> dict:
    """Sizes of one party's message in values and bits, and the ratio of bits; the mean and the count go uncompressed."""
    made, bits = codec(method, **params)
    size = made.size(d)
    total = size * bits + 64 * d + 64
    return {"original_size": original_size(d), "compressed_size": size, "compression_ratio": original_size(d) * 64 / total, "bits_per_value": bits, "total_bits": total}


def roundtrip(stats: DataFrame, made) -> DataFrame:
    """The statistics table with each covariance compressed and restored."""

    def run(frames):
        for pdf in frames:
            out = []
            for n, mean, m2 in zip(pdf["n"], pdf["mean"], pdf["m2"]):
                d = len(mean)
                back = made.decompress(made.compress(unpack(np.asarray(m2, float), d) / n), d)
                out.append(pack((back + back.T) / 2) * n)
            yield pd.DataFrame({"party": pdf["party"], "n": pdf["n"], "mean": pdf["mean"], "m2": out})

    return stats.select("party", "n", "mean", "m2").mapInPandas(run, stats.select("party", "n", "mean", "m2").schema)


def quantized_cells(cells: DataFrame, bits: int = 8) -> DataFrame:
    """(party, i, j, code, restored) of covariance cells, in built-in expressions."""
    levels = LEVELS[bits]
    w = Window.partitionBy("party")
    scaled = cells.withColumn("low", F.min("value").over(w)).withColumn("high", F.max("value").over(w))
    unit = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    scaled = scaled.withColumn("code", F.floor(unit * levels).cast("int"))
    return scaled.select("party", "i", "j", "code", (F.col("code") / levels * (F.col("high") - F.col("low")) + F.col("low")).alias("restored"))


def largest_cells(cells: DataFrame, k: int) -> DataFrame:
    """(party, i, j, value): each party's k cells of largest magnitude, and its diagonal."""
    w = Window.partitionBy("party").orderBy(F.desc(F.abs("value")), "i", "j")
    return cells.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) | (F.col("i") == F.col("j"))).drop("r")


@dataclass
class CompressedPCA(Estimator):
    """P-COV on covariances that went through a codec; the pooled matrix is made positive semidefinite."""

    method: str = "low_rank"
    rank: int = 100
    sketch: int = 200
    bits: int = 16
    top_k: int = 10_000
    seed: int = 42
    residual: str = "coordinate"
    rounding: str = "trunc"
    name = "Compressed"

    def _params(self) -> dict:
        return {"rank": self.rank, "sketch": self.sketch, "bits": self.bits, "k": self.top_k, "seed": self.seed, "residual": self.residual, "rounding": self.rounding}

    def __post_init__(self) -> None:
        super().__post_init__()
        codec(self.method, **self._params())

    def aggregate(self, stats: DataFrame) -> PCAModel:
        made, _ = codec(self.method, **self._params())
        (n,), mean, second = sum_over(stats, lambda x: _restored_second(x, made))
        mean = mean / n
        values, vectors = np.linalg.eigh(nearest_psd(second / n - np.outer(mean, mean)))
        values = np.maximum(values[::-1], 0)
        return PCAModel.build(vectors[:, ::-1].T[: self.n_components], mean, values[: self.n_components], values.sum(), int(n))

    def compression_stats(self) -> dict:
        self.model  # noqa: B018
        return compression_stats(self.method, self._dims, **self._params())

    def compression_report(self) -> str:
        s = self.compression_stats()
        return "\n".join([f"method {self.method}, {self._parties} parties, {self._dims} features", *(f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in s.items())])


def _restored_second(x: Moments, made):
    d = len(x.mean)
    back = made.decompress(made.compress(x.cov), d)
    return [x.n], x.n * x.mean, x.n * ((back + back.T) / 2 + np.outer(x.mean, x.mean))


#: The configurations that evaluate_compression compares.
CONFIGS = [("none", {}), ("low_rank", {"rank": 50}), ("low_rank", {"rank": 100}), ("low_rank", {"rank": 200}), ("quantize", {"bits": 16}), ("quantize", {"bits": 8}), ("sketch", {"sketch": 100}), ("sketch", {"sketch": 200}), ("top_k", {"top_k": 5000})]


def evaluate_compression(spark: SparkSession, samples: DataFrame, stats: DataFrame, k: int, configs=CONFIGS) -> DataFrame:
    """(method, params, mean_angle, compression_ratio, kilobytes) for each configuration, from one statistics table."""
    from .estimators import PooledCovariance
    from .metrics import principal_angles

    truth = PooledCovariance(k).fit(samples, stats).model
    rows = []
    for method, params in configs:
        est = CompressedPCA(k, method=method, **params).fit(samples, stats)
        s = est.compression_stats()
        angle = float(np.degrees(principal_angles(truth.components, est.model.components)).mean())
        rows.append((method, ",".join(f"{a}={b}" for a, b in params.items()), angle, float(s["compression_ratio"]), s["total_bits"] / 8 / 1024))
    return spark.createDataFrame(rows, "method string, params string, mean_angle double, compression_ratio double, kilobytes double")

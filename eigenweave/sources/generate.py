"""Synthetic fixtures: blobs, correlated images, block patterns, noise; rows are drawn on the executors.

Class means and mixing matrices come from a seeded driver stream and travel with the task (at most
classes x d and d x d doubles); each chunk of CHUNK rows has its own stream from (seed, chunk), so
values do not depend on partitioning and any number of rows can be made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHUNK = 4096
SCHEMA = "party int, row_id long, features array<double>, label int"


def _rows(spark: SparkSession, n: int, seed: int, draw: Callable[[np.random.RandomState, int, int], tuple[np.ndarray, np.ndarray]], party: int = 0) -> DataFrame:
    chunks = max(1, -(-n // CHUNK))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for c in pdf["id"]:
                first, size = c * CHUNK, min(CHUNK, n - c * CHUNK)
                if size > 0:
                    x, y = draw(np.random.RandomState([seed % 2**32, party, c]), first, size)
                    yield pd.DataFrame({"party": np.full(size, party, np.int32), "row_id": np.arange(first, first + size) + party * (1 << 40), "features": list(x), "label": y.astype(np.int32)})

    return spark.range(chunks).mapInPandas(run, SCHEMA)


def blobs(spark: SparkSession, n: int = 5000, d: int = 100, classes: int = 10, seed: int = 42, spread: float = 3.0, noise: float = 0.5) -> DataFrame:
    """Gaussian classes: means spread * N(0, 1), rows with deviation noise, classes in turn by a shuffled draw."""
    means = np.random.RandomState(seed).randn(classes, d) * spread

    def draw(rng, first, size):
        y = rng.randint(0, classes, size)
        return means[y] + noise * rng.randn(size, d), y

    return _rows(spark, n, seed, draw)


def image_like(spark: SparkSession, n: int = 10_000, d: int = 784, classes: int = 10, seed: int = 42, length: float = 20.0) -> DataFrame:
    """Rows whose values correlate exponentially with distance, about class means of three to seven bumps."""
    rng = np.random.RandomState(seed)
    place = np.arange(d)
    root = np.linalg.cholesky(np.exp(-np.abs(place[:, None] - place[None, :]) / length) + 1e-6 * np.eye(d))
    means = np.zeros((classes, d))
    for k in range(classes):
        for _ in range(rng.randint(3, 8)):
            means[k] += rng.uniform(1, 3) * np.exp(-((place - rng.uniform(0, d)) ** 2) / (2 * rng.uniform(d / 50, d / 10) ** 2))

    def draw(own, first, size):
        y = own.randint(0, classes, size)
        return means[y] + 0.5 * own.randn(size, d) @ root.T, y

    return _rows(spark, n, seed, draw)


def block_rows(spark: SparkSession, n: int, d: int, class_id: int, seed: int, width: int = 10, height: float = 2.0, noise: float = 0.5, party: int = 0) -> DataFrame:
    """Noise with a block of `height` on `width` columns that the class picks, wrapped at d."""
    columns = (class_id * width + np.arange(width)) % d

    def draw(rng, first, size):
        x = noise * rng.randn(size, d)
        x[:, columns] += height
        return x, np.full(size, class_id)

    return _rows(spark, n, seed, draw, party)


def block_parties(spark: SparkSession, sizes: list[int], d: int, seed: int = 0, **params) -> DataFrame:
    """One block_rows party for each size, class and party numbered alike."""
    out = None
    for k, n in enumerate(sizes):
        part = block_rows(spark, n, d, k, seed + k, party=k, **params)
        out = part if out is None else out.unionByName(part)
    return out


def normal_parties(spark: SparkSession, parties: int = 5, n: int = 100, d: int = 50, seed: int = 42) -> DataFrame:
    """Parties of independent N(0, 1) rows."""
    out = None
    for k in range(parties):
        part = _rows(spark, n, seed, lambda rng, first, size: (rng.randn(size, d), np.zeros(size)), party=k)
        out = part if out is None else out.unionByName(part)
    return out

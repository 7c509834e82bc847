"""Estimators by name: thin policies over the statistics table, with their communication cost."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.samples import dimension
from . import combine
from .iterate import MATRIX_DIMS, subspace_iteration
from .model import NotFitted, PCAModel
from .stats import party_stats

FLOAT = 8


@dataclass
class Estimator:
    """fit(samples) sets `model`; transform, inverse_transform and fit_transform follow it."""

    n_components: int
    random_state: int | None = None
    name = "base"

    def __post_init__(self) -> None:
        if self.n_components < 1:
            raise ValueError("n_components must be at least 1")
        self._model: PCAModel | None = None
        self._parties = self._dims = 0

    @property
    def model(self) -> PCAModel:
        if self._model is None:
            raise NotFitted(f"{type(self).__name__} is not fitted")
        return self._model

    def local_statistics(self, samples: DataFrame) -> DataFrame:
        """What each party computes from its own rows."""
        return party_stats(samples)

    def aggregate(self, stats: DataFrame) -> PCAModel:
        """The server's part: statistics of all parties to one model."""
        raise NotImplementedError

    def fit(self, samples: DataFrame, stats: DataFrame | None = None) -> Estimator:
        """Fit on samples; a statistics table that is at hand is used instead of a scan."""
        own = stats is None
        table = self.local_statistics(samples).persist(StorageLevel.MEMORY_AND_DISK) if own else stats
        try:
            head = table.where("n > 0").agg(F.count(F.lit(1)).alias("k"), F.max(F.size("mean")).alias("d")).first()
            if not head["k"]:
                raise ValueError("no party has rows")
            self._parties, self._dims = head["k"], head["d"]
            self._model = self._fit(samples, table)
        finally:
            if own:
                table.unpersist()
        return self

    def _fit(self, samples: DataFrame, stats: DataFrame) -> PCAModel:
        return self.aggregate(stats)

    def transform(self, df: DataFrame, column: str = "features", out: str = "scores") -> DataFrame:
        return self.model.transform(df, column, out)

    def inverse_transform(self, df: DataFrame, column: str = "scores", out: str = "restored") -> DataFrame:
        return self.model.inverse_transform(df, column, out)

    def fit_transform(self, samples: DataFrame) -> DataFrame:
        return self.fit(samples).transform(samples)

    @property
    def components_(self) -> np.ndarray:
        return self.model.components

    @property
    def mean_(self) -> np.ndarray:
        return self.model.mean

    @property
    def explained_variance_(self) -> np.ndarray:
        return self.model.explained_variance

    @property
    def explained_variance_ratio_(self) -> np.ndarray:
        return self.model.explained_variance_ratio

    def get_communication_cost(self) -> dict:
        return self.communication_cost()

    def communication_cost(self) -> dict:
        """rounds, bytes_per_party and total_bytes of the last fit."""
        self.model  # noqa: B018
        rounds, each = self._cost(self._dims)
        return {"rounds": rounds, "bytes_per_party": each, "total_bytes": each * self._parties}

    def _cost(self, d: int) -> tuple[int, int]:
        return 0, 0


class Centralized(Estimator):
    """Ground truth: all rows as one party."""

    name = "Centralized"

    def local_statistics(self, samples: DataFrame) -> DataFrame:
        return party_stats(samples.withColumn("party", F.lit(0)))

    def aggregate(self, stats: DataFrame) -> PCAModel:
        return combine.pcov(stats, self.n_components)


class PooledCovariance(Estimator):
    name = "P-COV"

    def aggregate(self, stats: DataFrame) -> PCAModel:
        return combine.pcov(stats, self.n_components)

    def _cost(self, d: int) -> tuple[int, int]:
        return 2, FLOAT * (d + d * d)


@dataclass
class AveragedCovariance(Estimator):
    weighted: bool = True
    name = "AP-COV"

    def aggregate(self, stats: DataFrame) -> PCAModel:
        return combine.apcov(stats, self.n_components, self.weighted)

    def _cost(self, d: int) -> tuple[int, int]:
        return 1, FLOAT * (d * d + d)


@dataclass
class StackedAxes(Estimator):
    local_components: int | None = None
    name = "AP-STACK"

    def aggregate(self, stats: DataFrame) -> PCAModel:
        return combine.apstack(stats, self.n_components, self.local_components)

    def _cost(self, d: int) -> tuple[int, int]:
        return 1, FLOAT * d * (self.local_components or self.n_components)


@dataclass
class StackedQR(Estimator):
    local_components: int | None = None
    weighting: str = "reference"
    name = "QR-PCA"

    def aggregate(self, stats: DataFrame) -> PCAModel:
        return combine.qr(stats, self.n_components, self.local_components, self.weighting)

    def _fit(self, samples: DataFrame, stats: DataFrame) -> PCAModel:
        most = self.local_components or 2 * self.n_components
        self._sent = stats.where("n > 0").agg(F.sum(F.greatest(F.lit(0), F.least(F.lit(most), F.col("n") - 1, F.size("mean"))))).first()[0]
        return self.aggregate(stats)

    def communication_cost(self) -> dict:
        total = FLOAT * self._dims * self._sent if self._model else 0
        return super().communication_cost() | {"total_bytes": total}

    def _cost(self, d: int) -> tuple[int, int]:
        return 1, FLOAT * d * min(d, self.local_components or 2 * self.n_components)


@dataclass
class SubspaceIteration(Estimator):
    max_iter: int = 100
    tol: float = 1e-6
    name = "SUB-IT"

    def fit(self, samples: DataFrame, stats: DataFrame | None = None) -> Estimator:
        """As the others, but beyond MATRIX_DIMS features no party's matrix is made."""
        if stats is not None or (d := dimension(samples)) <= MATRIX_DIMS:
            return super().fit(samples, stats)
        self._parties, self._dims = samples.select("party").distinct().count(), d
        self._model = self._fit(samples, None)
        return self

    def _fit(self, samples: DataFrame, stats: DataFrame | None) -> PCAModel:
        return subspace_iteration(samples, self.n_components, self.max_iter, self.tol, self.random_state, stats)

    def communication_cost(self) -> dict:
        steps = self.model.info["iterations"]
        each = FLOAT * self._dims * self.n_components
        return {"rounds": steps + 1, "bytes_per_party": each, "total_bytes": (steps + 1) * self._parties * each, "iterations": steps, "history": self.model.info["history"]}


METHODS = {c.name: c for c in (Centralized, PooledCovariance, SubspaceIteration, StackedAxes, StackedQR, AveragedCovariance)}


def estimator(name: str, n_components: int, random_state: int | None = None, **params) -> Estimator:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(METHODS)}")
    return METHODS[name](n_components, random_state, **params)

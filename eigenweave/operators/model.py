"""A fitted principal component model: projection, reconstruction, and frames of itself."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linalg import canonical
from .stats import vectors

#: Products of size k * d up to which projection is a built-in expression and stays inside code generation.
SQL_CELLS = 64


@dataclass(frozen=True)
class PCAModel:
    """components: k x d rows; ratio is of the data's total variance, ratio_kept of the kept components' sum."""

    components: np.ndarray
    mean: np.ndarray
    explained_variance: np.ndarray
    total_variance: float
    n_samples: int = 0
    info: dict = field(default_factory=dict)

    @classmethod
    def build(cls, rows: np.ndarray, mean: np.ndarray, values: np.ndarray, total: float, n: int = 0, **info) -> PCAModel:
        return cls(canonical(np.atleast_2d(rows)), np.asarray(mean, float), np.asarray(values, float), float(total), n, info)

    @property
    def explained_variance_ratio(self) -> np.ndarray:
        return self.explained_variance / self.total_variance if self.total_variance > 0 else np.zeros_like(self.explained_variance)

    @property
    def explained_variance_ratio_kept(self) -> np.ndarray:
        kept = self.explained_variance.sum()
        return self.explained_variance / kept if kept > 0 else np.zeros_like(self.explained_variance)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T

    def restore(self, z: np.ndarray) -> np.ndarray:
        return z @ self.components + self.mean

    def projection(self, features: Column) -> Column:
        """(x - mean) W' as a built-in expression, for small models."""
        centred = [features[i] - F.lit(float(m)) for i, m in enumerate(self.mean)]
        return F.array(*(sum((c * F.lit(float(w)) for c, w in zip(centred[1:], row[1:])), centred[0] * F.lit(float(row[0]))) for row in self.components))

    def reconstruction(self, scores: Column) -> Column:
        cols = self.components.T
        return F.array(*(sum((scores[j] * F.lit(float(w)) for j, w in enumerate(col)), F.lit(0.0)) + F.lit(float(m)) for col, m in zip(cols, self.mean)))

    def _map(self, df: DataFrame, column: str, out: str, width: int, apply) -> DataFrame:
        keep = [c for c in df.columns if c != out]
        schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = np.ascontiguousarray(apply(vectors(b.column(0), width)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], values], schema.names)

        return df.select(F.col(column).cast("array<double>").alias("__x"), *keep).mapInArrow(run, schema)

    def transform(self, df: DataFrame, column: str = "features", out: str = "scores") -> DataFrame:
        """df with the centred projection of a vector column. Large models multiply whole Arrow batches."""
        if self.components.size <= SQL_CELLS:
            return df.withColumn(out, self.projection(F.col(column).cast("array<double>")))
        return self._map(df, column, out, len(self.mean), self.project)

    def inverse_transform(self, df: DataFrame, column: str = "scores", out: str = "restored") -> DataFrame:
        if self.components.size <= SQL_CELLS:
            return df.withColumn(out, self.reconstruction(F.col(column)))
        return self._map(df, column, out, len(self.components), self.restore)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(idx, eigenvalue, ratio, ratio_kept, loadings), one row for each component."""
        rows = [(i, float(v), float(r), float(q), [float(x) for x in row]) for i, (v, r, q, row) in enumerate(zip(self.explained_variance, self.explained_variance_ratio, self.explained_variance_ratio_kept, self.components))]
        return spark.createDataFrame(rows, "idx int, eigenvalue double, ratio double, ratio_kept double, loadings array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table of components and a row for the rest, both Parquet."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/components")
        head = [([float(x) for x in self.mean], self.total_variance, int(self.n_samples), json.dumps(self.info))]
        spark.createDataFrame(head, "mean array<double>, total_variance double, n_samples long, info string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PCAModel:
        rows = spark.read.parquet(f"{path}/components").orderBy("idx").collect()
        head = spark.read.parquet(f"{path}/model").first()
        return cls(np.array([r["loadings"] for r in rows]), np.array(head["mean"]), np.array([r["eigenvalue"] for r in rows]), head["total_variance"], head["n_samples"], json.loads(head["info"]))


class NotFitted(ValueError):
    """Raised where a model is needed before fit."""

"""Per-party sufficient statistics (n, mean, covariance) as one distributed aggregation.

Up to SQL_DIMS features the aggregates are built-in (`avg`, `covar_pop`), so Catalyst plans partial
and final aggregation with code generation. Above, each task folds its Arrow batches into one
(n, mean, M2) per party with matrix products, and partial results merge in a tree of bounded fan-in,
one sorted row after another, so that a merge holds two matrices whatever it merges. Raw rows never leave
their task, and no group of rows is materialised. M2 travels as the packed upper triangle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.samples import dimension
from .linalg import pack, unpack

SQL_DIMS = 8
#: Tasks whose partial results one merge takes, and bytes of partial state that a task holds before it hands them on.
FAN_IN, STATE_BYTES = 64, 256 << 20


@dataclass
class Moments:
    """n, mean and M2 = sum of outer products about the mean. Merging is associative and commutative."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = np.asarray(x, float)
        if not len(x):
            return cls(0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1])))
        mean = x.mean(axis=0)
        c = x - mean
        return cls(len(x), mean, c.T @ c)

    @property
    def cov(self) -> np.ndarray:
        return self.m2 / max(self.n, 1)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        delta = other.mean - self.mean
        return Moments(n, self.mean + delta * (other.n / n), self.m2 + other.m2 + np.outer(delta, delta) * (self.n * other.n / n))

    def without(self, other: Moments) -> Moments:
        """The moments that, merged with other's, give these."""
        n = self.n - other.n
        if n < 0:
            raise ValueError("cannot take away more rows than there are")
        if n == 0:
            return Moments(0, np.zeros_like(self.mean), np.zeros_like(self.m2))
        mean = (self.n * self.mean - other.n * other.mean) / n
        delta = other.mean - mean
        return Moments(n, mean, self.m2 - other.m2 - np.outer(delta, delta) * (n * other.n / self.n))


def vectors(column: pa.Array, d: int | None = None) -> np.ndarray:
    """An Arrow list column as a matrix."""
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null value in a vector")
    lengths = pc.list_value_length(column)
    low, high = pc.min(lengths).as_py(), pc.max(lengths).as_py()
    if low != high or (d is not None and low is not None and low != d):
        raise ValueError(f"vectors of {low} to {high} values" + (f", expected {d}" if d is not None else ""))
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), low or 0)


def _schema(frame: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("party", frame.schema["party"].dataType), T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("m2", T.ArrayType(T.DoubleType())), *more])


def _sql_stats(frame: DataFrame, d: int) -> DataFrame:
    null = F.raise_error(F.lit("null value in a vector")).cast("double")
    f = [F.coalesce(F.col("features")[i], null) for i in range(d)]
    cells = [F.covar_pop(f[i], f[j]).alias(f"c{i}_{j}") if i != j else F.var_pop(f[i]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    got = frame.groupBy("party").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f[i]).alias(f"m{i}") for i in range(d)), *cells)
    m2 = F.array(*(F.col(f"c{i}_{j}") * F.col("n") for i in range(d) for j in range(i, d)))
    return got.select("party", "n", F.array(*(F.col(f"m{i}") for i in range(d))).alias("mean"), m2.alias("m2"))


def _partials(frame: DataFrame, d: int) -> DataFrame:
    schema = _schema(frame, T.StructField("task", T.IntegerType()))
    most = max(1, STATE_BYTES // (8 * (d * d + d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            names = pa.array(list(held), kind)
            cols = [pa.array([m.n for m in held.values()], pa.int64()), pa.array([m.mean for m in held.values()], pa.list_(pa.float64())), pa.array([pack(m.m2) for m in held.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([names, *cols, pa.array([task] * len(names), pa.int32())], schema.names)

        kind = None
        for b in batches:
            kind = b.column(0).type
            x, coded = vectors(b.column(1), d), b.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                party = coded.dictionary[int(codes[rows[0]])].as_py()
                got = Moments.of(x[rows])
                held[party] = held[party].merge(got) if party in held else got
            if len(held) > most:
                yield out()
                held.clear()
        if held:
            yield out()

    return frame.select("party", "features").mapInArrow(run, schema)


def tasks_of(df: DataFrame) -> int:
    """About as many tasks as df runs at most: scans by the plan's estimate of bytes, shuffles by their setting."""
    conf = df.sparkSession.conf
    split = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.files.maxPartitionBytes"))
    read = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(conf.get("spark.sql.shuffle.partitions")), min(read // max(split, 1) + 1, 1 << 24))


def merge_tree(parts: DataFrame, by: list[str], merge: Callable[[object, pd.Series], object], row: Callable[[object], dict], tasks: int) -> DataFrame:
    """Merge the rows of parts(by, task, ...) to one for each value of `by`, FAN_IN tasks at a time.

    merge(held, row) folds a row into what is held (None at first), row(held) gives the columns back. A
    step sorts its rows by key and streams through them, so it holds one merged value and one row.
    """
    schema = parts.schema

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({c: [v] for c, v in {**dict(zip([*by, "task"], key)), **row(held)}.items()})[schema.names]

        for pdf in frames:
            for k in range(len(pdf)):
                r = pdf.iloc[k]
                own = tuple(None if pd.isna(r[c]) else r[c] for c in by) + (int(r["task"]),)
                if key is not None and own != key:
                    yield out()
                    held = None
                key, held = own, merge(held, r)
        if key is not None:
            yield out()

    while True:
        last = tasks <= FAN_IN
        parts = parts.withColumn("task", F.lit(0) if last else F.floor(F.col("task") / FAN_IN).cast("int")).select(schema.names)
        parts = parts.repartition(*by, "task").sortWithinPartitions(*by, "task").mapInPandas(fold, schema)
        if last:
            return parts.drop("task")
        tasks = -(-tasks // FAN_IN)


def merge_moments(held: Moments | None, row: pd.Series) -> Moments:
    mean = np.asarray(row["mean"], float)
    one = Moments(int(row["n"]), mean, unpack(np.asarray(row["m2"], float), len(mean)))
    return one if held is None else held.merge(one)


def moments_row(m: Moments) -> dict:
    return {"n": m.n, "mean": m.mean, "m2": pack(m.m2)}


def party_stats(frame: DataFrame, d: int | None = None) -> DataFrame:
    """(party, n, mean, m2) for each party of a samples frame; m2 is the packed upper triangle of n times the covariance.

    A null party is a party. Vectors of different lengths, null vectors and null values raise, at
    any number of features. No rows, no parties.
    """
    if d is None:
        d = dimension(frame)
    if d <= SQL_DIMS:
        return _sql_stats(frame, d)
    return merge_tree(_partials(frame, d), ["party"], merge_moments, moments_row, tasks_of(frame))


def as_moments(row) -> Moments:
    mean = np.array(row["mean"], float)
    return Moments(int(row["n"]), mean, unpack(np.array(row["m2"], float), len(mean)))


def covariances(stats: DataFrame) -> DataFrame:
    """(party, i, j, value) of the parties' covariances, upper triangle with the diagonal."""
    cells = stats.select("party", F.size("mean").alias("d"), F.posexplode(F.transform("m2", lambda x: x / F.col("n"))).alias("k", "value"))
    at = F.expr("sequence(0, d - 1)")
    starts = F.transform(at, lambda i: i * F.col("d") - i * (i - 1) / 2)
    i = (F.size(F.filter(starts, lambda s: s <= F.col("k"))) - 1).cast("int")
    cells = cells.withColumn("i", i)
    return cells.select("party", "i", (F.col("k") - (F.col("i") * F.col("d") - F.col("i") * (F.col("i") - 1) / 2) + F.col("i")).cast("int").alias("j"), "value")

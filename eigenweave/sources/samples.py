"""The `samples` frame every operator takes: party, row_id, features array<double>, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dataset that a loader can name: table, feature column(s), id and label columns, class names.
DATASETS = {
    "embeddings": {"features": "embedding", "row_id": "vec_id", "label": "label", "class_names": [f"class {k}" for k in range(10)]},
    "lineitem": {"features": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "row_id": "l_orderkey", "label": None, "class_names": []},
}


def samples(df: DataFrame, features: str | Sequence[str | Column], party: str | Column | None = None, row_id: str | Column | None = None, label: str | Column | None = None) -> DataFrame:
    """Name the columns of df that make up samples.

    features is one array column, or several numeric columns. Rows without features (null, or with
    a null among the values) are dropped. Values are cast to double once, here.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    value = as_col(features).cast("array<double>") if isinstance(features, str | Column) else F.array(*(as_col(c).cast("double") for c in features))
    lit = lambda c, kind: F.lit(None).cast(kind) if c is None else as_col(c)
    party_col = F.lit(0).cast("int") if party is None else as_col(party)
    out = df.select(party_col.alias("party"), lit(row_id, "long").alias("row_id"), value.alias("features"), lit(label, "int").alias("label"))
    return out.where(F.col("features").isNotNull() & F.forall("features", lambda x: x.isNotNull()))


def load(spark, folder: str, name: str, party: str | Column | None = None) -> DataFrame:
    """A named dataset of a folder of Parquet tables as samples."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    info = DATASETS[name]
    return samples(spark.read.parquet(f"{folder}/{name}.parquet"), info["features"], party, info["row_id"], info["label"])


def dataset_info(spark, name: str) -> DataFrame:
    """(dataset, class_id, class_name) of a named dataset."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    rows = [(name, k, c) for k, c in enumerate(DATASETS[name]["class_names"])]
    return spark.createDataFrame(rows, "dataset string, class_id int, class_name string")


def dimension(frame: DataFrame, column: str = "features") -> int:
    """The common length of the vectors; ValueError if lengths differ or there is no row."""
    low, high = frame.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is None:
        raise ValueError("no rows")
    if low != high:
        raise ValueError(f"vectors of {low} to {high} values")
    return low


def pooled(*frames: DataFrame) -> DataFrame:
    """The rows of all parties' frames, by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def zscore(train: DataFrame, *others: DataFrame, dims: int | None = None) -> list[DataFrame]:
    """Frames scaled by the training frame's mean and population deviation plus 1e-8, taken in one aggregation."""
    d = dims or dimension(train)
    aggs = [f(F.col("features")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = train.agg(*aggs).first()
    mean, dev = F.array(*(F.lit(got[f"m{i}"]) for i in range(d))), F.array(*(F.lit(got[f"s{i}"] + 1e-8) for i in range(d)))
    scale = F.zip_with(F.zip_with("features", mean, lambda x, m: x - m), dev, lambda x, s: x / s)
    return [f.withColumn("features", scale) for f in (train, *others)]


def mean_shifted(frame: DataFrame, step: float = 2.0) -> DataFrame:
    """Every feature of party i raised by step * i."""
    return frame.withColumn("features", F.transform("features", lambda x: x + F.lit(step) * F.col("party")))


def label_histogram(frame: DataFrame) -> DataFrame:
    return frame.groupBy("party", "label").agg(F.count(F.lit(1)).alias("n"))


def sample_rows(frame: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those whose hash with the seed ranks first, the same for any partitioning."""
    return frame.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(n)

"""Write results: nested experiment results as flat rows, CSV or Parquet, text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def flatten(result: dict, prefix: tuple = ()) -> list[tuple[str, str, float]]:
    """(path, metric, value) of every number in nested dicts."""
    out = []
    for k, v in result.items():
        if isinstance(v, dict):
            out += flatten(v, (*prefix, str(k)))
        elif isinstance(v, int | float) and not isinstance(v, bool):
            out.append(("/".join(prefix), str(k), float(v)))
    return out


def results_frame(spark: SparkSession, result: dict) -> DataFrame:
    return spark.createDataFrame(flatten(result), "path string, metric string, value double")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {kind!r}")
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def text_report(spark: SparkSession, lines: str) -> DataFrame:
    """A report's lines as rows (line_no, line)."""
    return spark.createDataFrame(list(enumerate(lines.split("\n"))), "line_no int, line string")


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file system, for any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(data)
    out.close()

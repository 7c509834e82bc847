"""Written tables and small helpers of the corpus operators."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame

from ..sources.scratch import scratch

#: Words of every contract here: runs without ASCII white space (bytes.split() cuts at the same six bytes).
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 4000, "8m"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """written(), for what aggregation has made small beside the data.

    Adaptive execution merges small partitions before they become files; where that is turned off, a
    sixteenth as many files as shuffle partitions are written, as a file a partition is mostly overhead.
    """
    conf = df.sparkSession.conf
    merges = all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "coalescePartitions.enabled"))
    return written(df if merges else df.coalesce(max(8, int(conf.get("spark.sql.shuffle.partitions")) // 16)), "small")


def local_path(uri: str) -> str:
    """Path for open() and mmap of a shared folder that is mounted as files."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"binary files need a mounted shared folder, got {uri}")
    return unquote(u.path)


def make_dir(uri: str) -> str:
    path = local_path(uri)
    os.makedirs(path, exist_ok=True)
    return path


def check_input(df: DataFrame, *names: str) -> None:
    """The columns exist, and Arrow batches of the session hold BATCH_ROWS rows and BATCH_BYTES at most, as texts may be very long.

    The bounds are the session's, as a lazy plan reads them when it runs; smaller ones stay.
    """
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    conf, prefix = df.sparkSession.conf, "spark.sql.execution.arrow"
    to_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < int(conf.get(f"{prefix}.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set(f"{prefix}.maxRecordsPerBatch", str(BATCH_ROWS))
    if not 0 < to_bytes(conf.get(f"{prefix}.maxBytesPerBatch")) <= to_bytes(BATCH_BYTES):
        conf.set(f"{prefix}.maxBytesPerBatch", BATCH_BYTES)

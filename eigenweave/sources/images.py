"""Image files as samples: IDX pairs (digits) and binary records of one label byte and 3072 pixel bytes (small colour images).

Files are read by Spark (any store), plain or gzipped, a file a row, and parsed on the executors.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import samples

#: Fixed values of the IDX format: its element types; and the length of a record of colour images.
IDX_TYPES = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}
RECORD = 1 + 3 * 32 * 32
ROWS = 1000


def parse_idx(data: bytes) -> np.ndarray:
    """The array of an IDX file."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    if len(data) < 4 or data[:2] != b"\0\0" or data[2] not in IDX_TYPES:
        raise ValueError("not an IDX file")
    shape = struct.unpack_from(f">{data[3]}I", data, 4)
    kind = np.dtype(IDX_TYPES[data[2]])
    at = 4 + 4 * data[3]
    if len(data) - at != kind.itemsize * int(np.prod(shape)):
        raise ValueError("an IDX file of another length than its header says")
    return np.frombuffer(data, kind, offset=at).reshape(shape)


def _parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield from parse(name, bytes(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def load_idx(spark: SparkSession, images: str, labels: str, party: str | Column | None = None, normalize: bool = True) -> DataFrame:
    """Samples from a file of images and a file of their labels: row_id is the place, features are pixels, 0 to 1 if normalised."""

    def pixels(name: str, data: bytes) -> Iterator[pd.DataFrame]:
        x = parse_idx(data)
        x = x.reshape(len(x), -1)
        for k in range(0, len(x), ROWS):
            part = x[k : k + ROWS].astype(float) / (255.0 if normalize else 1.0)
            yield pd.DataFrame({"row_id": np.arange(k, k + len(part)), "pixels": list(part)})

    def marks(name: str, data: bytes) -> Iterator[pd.DataFrame]:
        y = parse_idx(data)
        yield pd.DataFrame({"row_id": np.arange(len(y)), "label": y.astype(np.int32)})

    rows = _parsed(spark, images, pixels, "row_id long, pixels array<double>").join(_parsed(spark, labels, marks, "row_id long, label int"), "row_id", "left")
    return samples(rows, "pixels", party, "row_id", "label")


def load_records(spark: SparkSession, path: str, party: str | Column | None = None, normalize: bool = True) -> DataFrame:
    """Samples from files of binary records; row_id is the file's number by name times 2^32 plus the place."""

    def records(name: str, data: bytes) -> Iterator[pd.DataFrame]:
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        if len(data) % RECORD:
            raise ValueError(f"{name}: not whole records")
        x = np.frombuffer(data, np.uint8).reshape(-1, RECORD)
        for k in range(0, len(x), ROWS):
            part = x[k : k + ROWS]
            yield pd.DataFrame({"path": name, "place": np.arange(k, k + len(part)), "label": part[:, 0].astype(np.int32), "pixels": list(part[:, 1:].astype(float) / (255.0 if normalize else 1.0))})

    rows = _parsed(spark, path, records, "path string, place long, label int, pixels array<double>")
    names = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    number = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k).cast("long"))))[F.col("path")]
    return samples(rows, "pixels", party, number * (1 << 32) + F.col("place"), "label")

"""Flat token-id files with 64-bit document offsets, written in id order and read through mmap.

A shard is three files: `<shard>.bin` holds the ids of its documents back to back as little-endian
unsigned integers (16 bits where the vocabulary allows, else 32), `<shard>.idx` the n + 1 offsets
of the documents as unsigned 64-bit integers, in ids from the shard's start, and `<shard>.doc` the
n document ids as signed 64-bit integers followed by n bytes that are 1 where the id is null.
`manifest.json` lists the shards in document order with their counts and bases; a base, the number
of ids in all shards before, is the prefix sum of the counts. The manifest has one entry a shard,
so its size follows the number of partitions, not of documents.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_input, local_path, make_dir, written

OUT_BYTES = 4 << 20


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text, append end_id, and write the shards to the folder out; returns the manifest.

    Documents lie in ascending order of id, null ids first, equal ids in an order fixed by their
    texts. A null or empty text is its end id. ids must be integers. An empty table gives a
    manifest without shards. A task that runs again replaces its files by equal ones.
    """
    check_input(docs, id_col, text_col)
    folder = make_dir(out)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(tokenizer)
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        end = np.array([end_id], np.uint32)
        shard = TaskContext.get().partitionId()
        stem, tmp = f"{folder}/{shard:06d}", f"{folder}/.{uuid.uuid4().hex}"
        counts, ids, nulls = [], [], []
        with open(f"{tmp}.bin", "wb") as f:
            for b in batches:
                for k in range(0, b.num_rows, 2000):
                    part = b.slice(k, 2000)
                    for x in enc.encode(part.column(1)):
                        f.write(np.concatenate((x, end)).astype("<u4" if wide else "<u2").tobytes())
                        counts.append(len(x) + 1)
                    ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                    nulls.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
        if not counts:
            os.remove(f"{tmp}.bin")
            return
        offsets = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
        offsets.tofile(f"{tmp}.idx")
        with open(f"{tmp}.doc", "wb") as f:
            f.write(np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())
        for kind in ("bin", "idx", "doc"):
            os.replace(f"{tmp}.{kind}", f"{stem}.{kind}")
        cols = [[shard], [len(counts)], [int(offsets[-1])], [4 if wide else 2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["shard", "docs", "tokens", "width"])

    parts = written(rows.select("id", "text").mapInArrow(run, "shard long, docs long, tokens long, width long"), "shards")
    shards, base = [], 0
    for r in sorted(parts.collect()):
        shards.append({**r.asDict(), "base": base})
        base += r["tokens"]
    manifest = {"shards": shards, "tokens": base, "docs": sum(s["docs"] for s in shards)}
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump(manifest, f)
    return manifest


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids binary of little-endian 32-bit) for each document of a folder.

    doc_id is null where the written id was; ids may repeat. A folder without shards gives an empty table.
    """
    folder = local_path(out)
    with open(f"{folder}/manifest.json") as f:
        shards = json.load(f)["shards"]
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["shard"], s["docs"], s["width"], s["base"]) for s in shards], "shard long, docs long, width long, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, docs, width, base in zip(*(c.to_pylist() for c in b.columns)):
                stem = f"{folder}/{shard:06d}"
                ids = np.memmap(f"{stem}.bin", f"<u{width}", "r")
                offsets = np.memmap(f"{stem}.idx", "<u8", "r").astype(np.int64)
                names = np.memmap(f"{stem}.doc", "<i8", "r", shape=(docs,))
                nulls = np.memmap(f"{stem}.doc", "u1", "r", offset=8 * docs, shape=(docs,)).astype(bool)
                at = 0
                while at < docs:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + OUT_BYTES // 4, "right")) - 1)
                    to = min(to, docs, at + 10_000)
                    data = [ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() for k in range(at, to)]
                    cols = [pa.array(np.array(names[at:to]), pa.int64(), mask=nulls[at:to]), pa.array(base + offsets[at:to]), pa.array(np.diff(offsets[at : to + 1])), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])
                    at = to

    return listed.repartition(len(shards)).mapInArrow(run, schema)

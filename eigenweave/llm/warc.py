"""Web archives: WARC records in ZIP packages, written by partition and read by byte ranges.

A package is a ZIP file of stored members: `archive/data.warc.gz` with every record compressed on
its own, and `indexes/index.cdxj` with a line for each record that gives its offset and length
there. A reader parses the package's central directory (ZIP64 too), takes the index, and reads
each record by its range; nothing is unpacked to disk.

Pages with equal payloads are archived once: the smallest page id is a response record, the others
are revisit records that refer to it and keep only the HTTP header.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_input, local_path, make_dir, written
from .zip_range import RangeFile, data_start, directory

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OUT_BYTES, OUT_ROWS, READ = 4 << 20, 5000, 8 << 20


def classified(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the page of the equal payload if this is a revisit."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = written(same.where("n > 1 and first is not null").select("digest", "first"), "same")
    later = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(same, "digest", "left").select("id", "url", "payload", "digest", later.alias("refers_to"))


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, n: str) -> bytes:
    """One WARC/1.1 record. The HTTP header, which a revisit keeps, has the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}:{n}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}:>"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _squeeze(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, level: int = 1) -> DataFrame:
    """Write a record for each row of pages into packages in the folder out; returns (archive, records).

    A null html is an empty payload. Of payloads of at least min_bytes that are equal, the smallest
    id's is the response (every row with that id, should ids repeat). Rows without an id are revisits if a
    payload equal to theirs has an id. Extra columns are left aside. An empty table gives no package.
    """
    check_input(pages, id_col, url_col, html_col)
    folder = make_dir(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tmp, n, at = TaskContext.get().partitionId(), f"{folder}/.{uuid.uuid4().hex}", 0, 0
        lines: list[str] = []
        package = None
        for b in batches:
            for page, url, payload, digest, refers in zip(*b.columns):
                if package is None:
                    package = zipfile.ZipFile(tmp, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = package.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)
                page, url, digest, refers = page.as_py(), url.as_py(), digest.as_py(), refers.as_py()
                data = _squeeze(record(page, url, payload.as_py(), digest, refers, f"{part}.{n}"), level)
                member.write(data)
                lines.append(json.dumps({"url": url, "digest": f"sha256:{digest}", "offset": at, "length": len(data), "filename": "data.warc.gz"}))
                at, n = at + len(data), n + 1
        if package is None:
            return
        member.close()
        package.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in lines))
        package.close()
        os.replace(tmp, f"{folder}/{part:06d}.wacz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}.wacz"]), pa.array([n], pa.int64())], ["archive", "records"])

    return written(classified(pages, id_col, url_col, html_col, min_bytes).mapInArrow(run, "archive string, records long"), "archives")


def _page(urn: str | None) -> int | None:
    text = urn.split(":")[2].rstrip(">") if urn else ""
    return int(text) if text else None


def records(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of a package in index order, each read by its range (adjacent ones in one read)."""
    read = RangeFile(path)
    try:
        members = directory(read, read.size)
        start, index = data_start(read, members[WARC]), members[INDEX]
        lines = [json.loads(x) for x in read(data_start(read, index), index.size).decode().splitlines()]
        at, data = 0, b""
        for x in lines:
            o, n = x["offset"], x["length"]
            if not at <= o <= o + n <= at + len(data):
                at, data = o, read(start + o, min(max(n, READ), members[WARC].size - o))
            yield parse(zlib.decompress(data[o - at : o - at + n], 31))
    finally:
        read.close()


def read_archives(spark: SparkSession, out: str, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) for each record of the packages in a folder.

    A response's length and digest come from the payload read, a revisit's from its headers. A
    payload that doesn't match its digest is an error.
    """
    folder = local_path(out)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                for head, http, payload in records(f"{folder}/{name}"):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].partition(":")[2]
                    n = int(http["Content-Length"])
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                        raise ValueError(f"{name}: a payload doesn't match its digest")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), n, digest, kind, _page(head.get("WARC-Refers-To")), payload)[: 6 + with_payload])
                    held += len(payload) * with_payload
                    if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                        yield make(rows)
                        rows, held = [], 0
        if rows:
            yield make(rows)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(run, schema)

"""Structured Streaming: a stream of client events to versioned models.

events(seq, op, mode, client_id, features): `add` opens a client, `update` replaces or appends,
`remove` closes. The rows of one event share its seq, op and mode, and may come in several batches:
those that come later go on with it. State is one (n, mean, second moments) per client in the state store,
checkpointed by Spark, so that a lost executor resumes. Events of a client in one batch apply in order of
seq. An event that cannot apply (add of a client that exists, update or remove of one that doesn't, or a seq
that is past already) goes out as a rejected row with its reason and changes nothing. Each batch
that changes a client puts out its new statistics; foreachBatch joins them with the table of the batch before,
one row a client, and publishes table and model under the batch's id, which makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.combine import pcov
from ..operators.linalg import pack, unpack
from ..operators.model import PCAModel
from ..operators.stats import Moments

EVENTS = "seq long, op string, mode string, client_id string, features array<double>"
OUT = "client_id string, status string, reason string, seq long, n long, mean array<double>, m2 array<double>"
STATE = "seq long, op string, mode string, n long, mean array<double>, m2 array<double>"


class Rows:
    """Rows of one event on their way to moments: kept until there are more than features, then folded."""

    def __init__(self) -> None:
        self.count, self.rows, self.held = 0, [], None

    def add(self, x: np.ndarray) -> None:
        self.rows.append(x)
        self.count += len(x)
        if sum(map(len, self.rows)) > max(64, x.shape[1]):
            self._fold()

    def _fold(self) -> None:
        new = Moments.of(np.concatenate(self.rows))
        self.held, self.rows = new if self.held is None else self.held.merge(new), []

    def moments(self) -> Moments:
        if self.rows:
            self._fold()
        return self.held


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, last = None, (-1, "", "")
    if state.exists:
        *last, n, mean, m2 = state.get
        last = tuple(last)
        if n > 0:
            held = Moments(n, np.array(mean), unpack(np.array(m2), len(mean)))
    events: dict[tuple, Rows] = {}
    for pdf in frames:
        for at, part in pdf.fillna({"mode": ""}).groupby(["seq", "op", "mode"], sort=False):
            rows = events.setdefault((int(at[0]), *at[1:]), Rows())
            if at[1] != "remove":
                rows.add(np.stack(part["features"].to_numpy()))
    out, changed = [], False
    for event in sorted(events, key=lambda e: (e[0], ("add", "update", "remove").index(e[1]) if e[1] in ("add", "update", "remove") else 3, e[2])):
        seq, op, mode = event
        more = event == last  # rows of the event that came last
        why = None
        if not more:
            if seq < last[0]:
                why = "late"
            elif op == "add":
                why = None if held is None else "exists"
            elif op in ("update", "remove") and held is None:
                why = "unknown client"
            elif op not in ("update", "remove") or op == "update" and mode not in ("replace", "append"):
                why = "unknown operation"
        if why:
            out.append((key[0], "rejected", why, seq, 0, None, None))
            continue
        changed, last = True, event
        if op == "remove":
            held = None
        else:
            new = events[event].moments()
            held = held.merge(new) if held is not None and (more or mode == "append") else new
    if changed:
        empty = held is None
        values = (0, [], []) if empty else (held.n, held.mean.tolist(), pack(held.m2).tolist())
        state.update((*last, *values))
        out.append((key[0], "removed" if empty else "current", None, last[0], *values))
    if out:
        yield pd.DataFrame(out, columns=["client_id", "status", "reason", "seq", "n", "mean", "m2"])


def client_changes(events: DataFrame) -> DataFrame:
    """New statistics of each client that a batch changes, and rejected events."""
    return events.groupBy("client_id").applyInPandasWithState(_apply, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def advanced(before: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The table (client_id, n, mean, m2), one row a client, after a batch of changes."""
    new = changes.where("status != 'rejected'")
    now = new.where("status = 'current'").select("client_id", "n", "mean", "m2")
    return now if before is None else before.join(new.select("client_id"), "client_id", "left_anti").unionByName(now)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The batch ids under folder, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The statistics table after the last batch: party, n, mean, m2; removed clients are left out."""
    last = versions(spark, f"{path}/current")[-1]
    return spark.read.parquet(f"{path}/current/batch={last}").withColumnRenamed("client_id", "party")


def run_models(events: DataFrame, k: int, path: str, checkpoint: str, keep: int = 2):
    """Start a query that after each batch writes its changes, the clients' table and a model; returns it.

    Under path: changes/batch=<id> (rejected events too), current/batch=<id> of the last `keep` batches,
    models/<id>. A batch reads the table before it, never the log, so its cost follows its clients.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        changes = spark.read.parquet(f"{path}/changes/batch={batch_id}")
        older = [v for v in versions(spark, f"{path}/current") if v < batch_id]
        before = spark.read.parquet(f"{path}/current/batch={older[-1]}") if older else None
        advanced(before, changes).write.mode("overwrite").parquet(f"{path}/current/batch={batch_id}")
        stats = spark.read.parquet(f"{path}/current/batch={batch_id}").withColumnRenamed("client_id", "party")
        if not stats.isEmpty():
            pcov(stats, k).save(spark, f"{path}/models/{batch_id}")
        for v in older[: max(0, len(older) + 1 - keep)]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/batch={v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return client_changes(events).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_model(spark, path: str, batch_id: int) -> PCAModel:
    return PCAModel.load(spark, f"{path}/models/{batch_id}")


def windowed_moments(events: DataFrame, value: str, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Streaming count, mean and population variance of a value by event-time window and key, with a watermark."""
    win = events.withWatermark(time, delay).groupBy(F.window(time, width), by)
    return win.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")).select(F.col("window.start").alias("start"), by, "n", "mean", "variance")

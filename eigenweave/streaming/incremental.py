"""A federation whose parties come, change and go, kept as statistics.

The driver-side class serves interactive use: its state is one (n, mean, M2) per party, and the
global moments are merged and un-merged as parties change, with a full rebuild after `threshold`
updates. Parties' rows are Spark frames. Parties that come as a frame or a table stay in a written
table of statistics; the driver holds their row counts, the global moments and, of parties that
change one by one, at most HELD_BYTES of matrices, which go to the table beyond that. One party's
moments are read back when it changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import from_covariance, pooled_moments
from ..operators.linalg import pack
from ..operators.model import NotFitted, PCAModel
from ..operators.stats import Moments, as_moments, party_stats
from ..sources.scratch import scratch

HELD_BYTES = 256 << 20
TABLE = "party string, n long, mean array<double>, m2 array<double>"


class Clients:
    """Each client's moments, by name: in memory for the latest, in written tables for the others."""

    def __init__(self, held_bytes: int = HELD_BYTES):
        self.sizes: dict[str, int] = {}
        self.held_bytes = held_bytes
        self._own: dict[str, Moments] = {}
        self._at: dict[str, int] = {}
        self._tables: list[DataFrame] = []

    def __contains__(self, name: str) -> bool:
        return name in self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def __iter__(self):
        return iter(self.sizes)

    def load(self, stats: DataFrame) -> None:
        """Take all parties of a statistics table, which is written."""
        path = scratch(stats.sparkSession, "clients")
        stats.select(F.col("party").cast("string").alias("party"), "n", "mean", "m2").write.parquet(path)
        self._tables.append(stats.sparkSession.read.schema(TABLE).parquet(path))
        for r in self._tables[-1].select("party", "n").orderBy("party").collect():
            self.sizes[str(r["party"])] = r["n"]
            self._at[str(r["party"])] = len(self._tables) - 1
            self._own.pop(str(r["party"]), None)

    def __getitem__(self, name: str) -> Moments:
        if name in self._own:
            return self._own[name]
        return as_moments(self._tables[self._at[name]].where(F.coalesce("party", F.lit("None")) == name).first())

    def __setitem__(self, name: str, m: Moments) -> None:
        self.sizes[name] = m.n
        self._own[name] = m
        self._at.pop(name, None)
        spark = SparkSession.getActiveSession()
        if spark and sum(x.m2.nbytes for x in self._own.values()) > self.held_bytes:
            rows = pd.DataFrame([(k, x.n, x.mean.tolist(), pack(x.m2).tolist()) for k, x in self._own.items()], columns=["party", "n", "mean", "m2"])
            self._own = {}
            self.load(spark.createDataFrame(rows, TABLE))

    def pop(self, name: str) -> Moments:
        m = self[name]
        del self.sizes[name]
        self._own.pop(name, None)
        self._at.pop(name, None)
        return m

    def pooled(self) -> Moments | None:
        """All clients' moments together, merged on the executors where they lie."""
        total = None
        for m in self._own.values():
            total = m if total is None else total.merge(m)
        for k, table in enumerate(self._tables):
            live = [name for name, at in self._at.items() if at == k]
            if live:
                names = table.sparkSession.createDataFrame([(x,) for x in live], "live string")
                m = pooled_moments(table.join(names, F.coalesce("party", F.lit("None")) == F.col("live"), "left_semi"))
                total = m if total is None else total.merge(m)
        return total


class StreamingPCA:
    """add_client, update_client and remove_client keep `model` up to date."""

    def __init__(self, n_components: int, threshold: int = 100):
        if n_components < 1:
            raise ValueError("n_components must be at least 1")
        self.n_components, self.threshold = n_components, threshold
        self.clients = Clients()
        self.history: list[tuple[str, str, int]] = []
        self.total: Moments | None = None
        self.update_counter = self._since = self._clock = 0
        self.updated: dict[str, int] = {}
        self._model: PCAModel | None = None

    @property
    def model(self) -> PCAModel:
        if self._model is None:
            raise NotFitted("no client has been added")
        return self._model

    @staticmethod
    def statistics(rows: DataFrame) -> Moments:
        """One client's rows (any party column is ignored) as moments."""
        got = party_stats(rows.withColumn("party", F.lit(0))).collect()
        if not got:
            raise ValueError("no rows")
        return as_moments(got[0])

    def fit(self, samples: DataFrame) -> StreamingPCA:
        """Add every party of a samples frame, from one aggregation; an id that is there already is an error."""
        stats = party_stats(samples)
        before = set(self.clients)
        if before and (twice := before & {str(r["party"]) for r in samples.select("party").distinct().collect()}):
            raise ValueError(f"clients exist: {', '.join(sorted(twice))}")
        self.clients.load(stats)
        for name in self.clients:
            if name not in before:
                self._enter("add", name, recompute=False)
        return self.recompute()

    def _enter(self, action: str, client: str, recompute: bool) -> None:
        self.update_counter += 1
        self._since += 1
        self.updated[client] = self.update_counter
        self.history.append((action, client, self.update_counter))
        if recompute:
            if self._since >= self.threshold:
                self.recompute()
            else:
                self._decompose()

    def _moments(self, data: DataFrame | Moments) -> Moments:
        return data if isinstance(data, Moments) else self.statistics(data)

    def add_client(self, client: str, data: DataFrame | Moments, recompute: bool = True) -> StreamingPCA:
        if client in self.clients:
            raise ValueError(f"client {client!r} exists")
        m = self._moments(data)
        self.clients[client] = m
        self.total = m if self.total is None else self.total.merge(m)
        self._enter("add", client, recompute)
        return self

    def update_client(self, client: str, data: DataFrame | Moments, mode: str = "replace", recompute: bool = True) -> StreamingPCA:
        if client not in self.clients:
            raise ValueError(f"no client {client!r}")
        if mode not in ("replace", "append"):
            raise ValueError(f"unknown mode {mode!r}")
        m = self._moments(data)
        if mode == "append":
            self.clients[client], self.total = self.clients[client].merge(m), self.total.merge(m)
        else:
            self.total = self.total.without(self.clients[client]).merge(m)
            self.clients[client] = m
        self._enter(f"update_{mode}", client, recompute)
        return self

    def remove_client(self, client: str, recompute: bool = True) -> StreamingPCA:
        if client not in self.clients:
            raise ValueError(f"no client {client!r}")
        gone = self.clients.pop(client)
        self.total = self.total.without(gone) if self.clients else None
        self._enter("remove", client, recompute)
        self.updated.pop(client)
        return self

    def recompute(self) -> StreamingPCA:
        """Global moments anew from the clients', then the model. Without clients there is no model."""
        self.total = self.clients.pooled()
        self._since = 0
        return self._decompose()

    def _decompose(self) -> StreamingPCA:
        if self.total is None or not self.total.n:
            self._model = None
        else:
            self._model = from_covariance(self.total.mean, self.total.cov, min(self.n_components, len(self.total.mean)), self.total.n)
        return self

    def aggregate(self, stats: DataFrame) -> StreamingPCA:
        """Replace the federation by a statistics table; history and counter stay."""
        self.clients = Clients()
        self.clients.load(stats)
        return self.recompute()

    def contribution(self, client: str) -> float:
        return self.clients.sizes[client] / self.total.n if client in self.clients else 0.0

    def status(self, spark: SparkSession) -> DataFrame:
        """One row on the federation and its model."""
        ratio = float(np.sum(self._model.explained_variance_ratio)) if self._model else None
        row = (len(self.clients), self.total.n if self.total else 0, len(self.total.mean) if self.total else None, self.n_components, self._model is not None, self.update_counter, self._since, ratio)
        return spark.createDataFrame([row], "n_clients int, n_samples long, n_features int, n_components int, fitted boolean, update_counter long, since_recompute long, explained double")

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "action string, client_id string, seq long")

"""Assign rows to parties: IID, Dirichlet label skew, label shards, quantity skew.

Every rule maps a row's own fixed uniform number u(row_id, seed) through tables of one row a label
or a party, so nothing is sorted, shuffled or ranked, and a rerun with any partitioning assigns
alike. Shares hold in expectation, with the deviation of a random draw. `iid` and `shard` also deal
exactly equal parts (exact=True), by a rank that needs no sort of the whole: rows are counted by
label and leading bits of their number, and ranked within such a bucket only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose tables may travel as literals of the plan.
MAX_LABELS = 10_000


def uniform(row_id: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5, which SQL engines agree on."""
    col = F.col(row_id) if isinstance(row_id, str) else row_id
    digits = F.substring(F.md5(F.concat(col.cast("string"), F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


@dataclass(frozen=True)
class DataPartitioner:
    num_clients: int
    seed: int = 42

    def __post_init__(self) -> None:
        if self.num_clients < 1:
            raise ValueError("num_clients must be at least 1")

    def _place(self, frame: DataFrame, shares: Column) -> DataFrame:
        """party = number of cumulative shares that u has passed."""
        u = uniform("row_id", self.seed)
        party = F.least(F.size(F.filter(shares, lambda s: s <= F.col("__u"))), F.lit(self.num_clients - 1))
        return frame.withColumn("__u", u).withColumn("party", party.cast("int")).drop("__u")

    def iid(self, frame: DataFrame, exact: bool = False) -> DataFrame:
        if exact:  # rank modulo parties: sizes differ by one at most
            ranked = _ranked(frame, F.lit(0), self.seed)
            return ranked.withColumn("party", F.pmod("__rank", F.lit(self.num_clients)).cast("int")).select(*frame.columns)
        party = F.floor(uniform("row_id", self.seed) * self.num_clients)
        return frame.withColumn("party", party.cast("int"))

    def dirichlet_shares(self, labels: list, alpha: float) -> dict:
        """Each label's shares of the parties, drawn from Dir(alpha) in label order."""
        if alpha <= 0:
            raise ValueError("alpha must be positive")
        rng = np.random.RandomState(self.seed)
        return {x: rng.dirichlet([alpha] * self.num_clients) for x in labels}

    def dirichlet(self, frame: DataFrame, alpha: float = 0.5) -> DataFrame:
        shares = self.dirichlet_shares(_labels(frame), alpha)
        table = _literal_map({x: np.cumsum(s)[:-1].tolist() for x, s in shares.items()})
        return self._place(frame, F.coalesce(table[F.col("label")], F.array().cast("array<double>")))

    def shard(self, frame: DataFrame, shards_per_client: int = 2, exact: bool = False) -> DataFrame:
        """Rows in label order cut into equal shards, which are dealt to the parties at random. Rows without a label have no place: exact deals them as a label after the others, else their party is null."""
        total = self.num_clients * shards_per_client
        counts = {r["label"]: r["count"] for r in _counted(frame)}
        n, at, starts = sum(counts.values()), 0, {}
        for x in sorted(counts):
            starts[x] = [at / n, counts[x] / n]
            at += counts[x]
        place = _literal_map(starts)[F.col("label")]
        position = place[0] + uniform("row_id", self.seed) * place[1]
        deal = np.random.RandomState(self.seed).permutation(total) // shards_per_client
        owner = F.array(*(F.lit(int(p)) for p in deal))
        if exact:
            ranked, n = _ranked(frame, F.col("label"), self.seed), frame.count()
            at = F.least(F.floor(F.col("__rank") * total / F.lit(max(n, 1))), F.lit(total - 1)).cast("int")
            return ranked.withColumn("party", F.element_at(owner, at + 1)).select(*frame.columns)
        at = F.least(F.floor(position * total), F.lit(total - 1)).cast("int")
        return frame.withColumn("party", F.element_at(owner, at + 1))

    def quantity_shares(self, power: float) -> np.ndarray:
        raw = np.arange(1, self.num_clients + 1) ** -float(power)
        return raw / raw.sum()

    def quantity_skew(self, frame: DataFrame, power: float = 1.5) -> DataFrame:
        cuts = np.cumsum(self.quantity_shares(power))[:-1]
        return self._place(frame, F.array(*map(F.lit, map(float, cuts))).cast("array<double>"))

    def partition(self, frame: DataFrame, kind: str, **params) -> DataFrame:
        kinds = {"iid": self.iid, "dirichlet": self.dirichlet, "shard": self.shard, "quantity_skew": self.quantity_skew, "quantity": self.quantity_skew}
        if kind not in kinds:
            raise ValueError(f"unknown partition {kind!r}; known: {', '.join(kinds)}")
        return kinds[kind](frame, **params)


def _ranked(frame: DataFrame, label: Column, seed: int, bits: int = 12) -> DataFrame:
    """frame with __rank from 0, in order of label (null last) and the row's fixed number; ties by row_id.

    The windows over buckets hold one row a bucket; rows are ranked inside a bucket of 2^-bits of a label.
    """
    rows = frame.withColumn("__u", uniform("row_id", seed)).withColumn("__l", label).withColumn("__b", F.floor(F.col("__u") * (1 << bits)))
    sizes = rows.groupBy("__l", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col("__l").isNull(), "__l", "__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__l").alias("__sl"), F.col("__b").alias("__sb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(sizes, F.col("__l").eqNullSafe(F.col("__sl")) & (F.col("__b") == F.col("__sb")))
    inside = F.row_number().over(Window.partitionBy("__l", "__b").orderBy("__u", "row_id")) - 1
    return rows.withColumn("__rank", F.col("__before") + inside)


def _counted(frame: DataFrame) -> list:
    rows = frame.where("label is not null").groupBy("label").count().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return rows


def _labels(frame: DataFrame) -> list:
    return sorted(r["label"] for r in _counted(frame))


def _literal_map(table: dict) -> Column:
    if not table:
        return F.create_map().cast("map<int,array<double>>")
    return F.create_map(*(c for k, v in table.items() for c in (F.lit(k).cast("int"), F.array(*map(F.lit, v)).cast("array<double>"))))


def partition_stats(frame: DataFrame) -> DataFrame:
    """One row: n_parties, min_samples, max_samples, mean_samples, mean_emd.

    mean_emd is the unweighted mean over parties of the L1 distance of the party's label shares to
    the whole's.
    """
    cells = frame.groupBy("party", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("party").agg(F.sum("n").alias("size"))
    labels = cells.groupBy("label").agg(F.sum("n").alias("all"))
    total = labels.agg(F.sum("all").alias("total"))
    # a label that a party lacks adds its whole share: start from 1, the sum of all shares, and correct the cells that exist
    parts = cells.join(sizes, "party").join(labels, "label").join(F.broadcast(total))
    own, whole = F.col("n") / F.col("size"), F.col("all") / F.col("total")
    emd = parts.groupBy("party").agg((F.lit(1.0) + F.sum(F.abs(own - whole) - whole)).alias("emd"))
    return sizes.join(emd, "party").agg(F.count(F.lit(1)).alias("n_parties"), F.min("size").alias("min_samples"), F.max("size").alias("max_samples"), F.avg("size").alias("mean_samples"), F.avg("emd").alias("mean_emd"))

"""Differentially private release: clipping, Gaussian noise on statistics, a privacy ledger.

Clipping and statistics are Spark work; noise is drawn once on the driver, in party order from a
seeded stream, and never inside a plan that a retry could evaluate again with other draws. The
accountant is charged by fit. The noise scale is the classic Gaussian mechanism with half of
epsilon and delta on each of mean and covariance; its proof needs epsilon / 2 < 1, and a clip bound
taken from the data (the default) is itself not private.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.samples import sample_rows
from .estimators import Estimator
from .linalg import nearest_psd
from .model import PCAModel
from .stats import Moments, as_moments, party_stats

TINY = 1e-10


@dataclass
class Accountant:
    """Basic composition over a budget of (epsilon, delta)."""

    epsilon: float
    delta: float
    spent_epsilon: float = 0.0
    spent_delta: float = 0.0
    queries: list[dict] = field(default_factory=list)

    def can_spend(self, epsilon: float, delta: float = 0.0) -> bool:
        return self.spent_epsilon + epsilon <= self.epsilon * (1 + 1e-12) and self.spent_delta + delta <= self.delta * (1 + 1e-12)

    def spend(self, epsilon: float, delta: float = 0.0, what: str = "") -> None:
        if not self.can_spend(epsilon, delta):
            raise ValueError(f"privacy budget exceeded: {self.remaining()} left, asked ({epsilon}, {delta})")
        self.spent_epsilon += epsilon
        self.spent_delta += delta
        self.queries.append({"what": what, "epsilon": epsilon, "delta": delta})

    def remaining(self) -> tuple[float, float]:
        return self.epsilon - self.spent_epsilon, self.delta - self.spent_delta

    def summary(self) -> dict:
        left = self.remaining()
        return {"epsilon": self.epsilon, "delta": self.delta, "spent_epsilon": self.spent_epsilon, "spent_delta": self.spent_delta, "remaining_epsilon": left[0], "remaining_delta": left[1], "n_queries": len(self.queries)}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(q["what"], q["epsilon"], q["delta"]) for q in self.queries], "what string, epsilon double, delta double")


def noise_scale(sensitivity: float, epsilon: float, delta: float) -> float:
    """Standard deviation of the Gaussian mechanism."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    if not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    return float(sensitivity * np.sqrt(2 * np.log(1.25 / delta)) / epsilon)


def norm(column: str = "features"):
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x))


def clip(df: DataFrame, bound: float, per_sample: bool = True, column: str = "features") -> DataFrame:
    """Rows scaled to a norm of at most bound, or all rows by one factor so that the matrix has it."""
    if per_sample:
        factor = F.least(F.lit(1.0), F.lit(float(bound)) / (F.col("__norm") + TINY))
        rows = df.withColumn("__norm", norm(column))
    else:
        whole = df.agg(F.sqrt(F.sum(norm(column) * norm(column)))).first()[0] or 0.0
        factor, rows = F.lit(min(1.0, bound / (whole + TINY))), df
    # the norm is read once a row, outside the lambda
    return rows.withColumn("__factor", factor).withColumn(column, F.transform(column, lambda x: x * F.col("__factor"))).drop("__norm", "__factor")


#: Values that one buffer sorts; more are bracketed by quantile sketches first.
SORTED = 100_000


def exact_percentile(values: DataFrame, share: float, held: int = SORTED) -> float | None:
    """The percentile of the one column of values, with linear interpolation; None without rows.

    A sketch brackets the two order statistics, and the values inside the bracket are bracketed
    again until they fit one buffer, which sorts them.
    """
    v = values.columns[0]
    rows = values.where(F.col(v).isNotNull())
    n = rows.count()
    if not n:
        return None
    place = (n - 1) * share
    low, high = int(np.floor(place)), int(np.ceil(place))

    def order(k: int) -> float:
        inside, before, m = rows, 0, n
        while m > held:
            at = [max(0.0, (k - before) / m - 1e-3), min(1.0, (k - before + 1) / m + 1e-3)]
            a, b = inside.agg(F.percentile_approx(v, at, 10_000)).first()[0]
            if at[0] == 0.0:
                a = inside.agg(F.min(v)).first()[0]
            if at[1] == 1.0:
                b = inside.agg(F.max(v)).first()[0]
            less, some = rows.agg(F.sum((F.col(v) < a).cast("long")), F.sum(F.col(v).between(a, b).cast("long"))).first()
            if not less <= k < less + some:
                raise ArithmeticError("the sketch missed its bracket")
            if a == b:
                return float(a)
            if some >= m:  # ties hold the bracket open: take them off either end
                first = rows.agg(F.sum((F.col(v) <= a).cast("long")), F.sum((F.col(v) < b).cast("long"))).first()
                if k < first[0]:
                    return float(a)
                if k >= first[1]:
                    return float(b)
                inside, before, m = rows.where((F.col(v) > a) & (F.col(v) < b)), first[0], first[1] - first[0]
            else:
                inside, before, m = rows.where(F.col(v).between(a, b)), less, some
        return float(inside.agg(F.sort_array(F.collect_list(v))).first()[0][k - before])

    x = order(low)
    return x if high == low else x + (place - low) * (order(high) - x)


def clip_bound(df: DataFrame, share: float = 0.95, column: str = "features") -> float:
    """The exact percentile of row norms, with linear interpolation."""
    found = exact_percentile(df.select(norm(column).alias("norm")), share)
    if found is None:
        raise ValueError("no rows")
    return found


def noisy(moments: Moments, bound: float, epsilon: float, delta: float, rng: np.random.RandomState) -> tuple[Moments, dict]:
    """A party's released statistics and what was added: mean noise first, then a symmetric matrix."""
    n, d = moments.n, len(moments.mean)
    scale_m, scale_c = noise_scale(bound / n, epsilon / 2, delta / 2), noise_scale(2 * bound**2 / n, epsilon / 2, delta / 2)
    add_m = rng.normal(0, scale_m, d)
    g = rng.normal(0, scale_c, (d, d))
    add_c = (g + g.T) / 2
    cov = moments.cov
    info = {
        "n_samples": n,
        "mean_noise_scale": scale_m,
        "cov_noise_scale": scale_c,
        "mean_noise_norm": float(np.linalg.norm(add_m)),
        "cov_noise_norm": float(np.linalg.norm(add_c)),
        "snr_mean": float(np.linalg.norm(moments.mean) / (np.linalg.norm(add_m) + TINY)),
        "snr_cov": float(np.linalg.norm(cov) / (np.linalg.norm(add_c) + TINY)),
    }
    return Moments(n, moments.mean + add_m, n * (cov + add_c)), info


def private_model(parts: list[Moments], k: int) -> PCAModel:
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    values, vectors = np.linalg.eigh(nearest_psd(total.cov))
    values = np.maximum(values[::-1], 0)
    return PCAModel.build(vectors[:, ::-1].T[:k], total.mean, values[:k], values.sum(), total.n)


@dataclass
class PrivatePCA(Estimator):
    """P-COV on noisy statistics. Party statistics are released one by one, so the driver holds one d x d matrix a party."""

    epsilon: float = 1.0
    delta: float = 1e-5
    clip_bound: float | None = None
    accountant: Accountant | None = None
    name = "DP-PCA"

    def fit(self, samples: DataFrame, stats: DataFrame | None = None) -> PrivatePCA:
        noise_scale(1, self.epsilon, self.delta)
        self.accountant = self.accountant or Accountant(self.epsilon, self.delta)
        self.accountant.spend(self.epsilon, self.delta, "fit")
        if self.clip_bound is None:
            self.clip_bound = clip_bound(samples)
        table = party_stats(clip(samples, self.clip_bound))
        rng, self.noise_info, parts = np.random.RandomState(self.random_state), [], []
        for row in table.orderBy("party").toLocalIterator():
            out, info = noisy(as_moments(row), self.clip_bound, self.epsilon, self.delta, rng)
            self.noise_info.append({"party": row["party"]} | info)
            parts.append(out)
            if len(parts) > 1:  # merge as they come
                parts = [parts[0].merge(parts[1])]
        if not parts:
            raise ValueError("no party has rows")
        self._model, self._parties, self._dims = private_model(parts, self.n_components), len(self.noise_info), len(parts[0].mean)
        return self

    def noise_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(str(x["party"]), x["n_samples"], *(x[c] for c in NOISE)) for x in self.noise_info]
        return spark.createDataFrame(rows, "party string, n_samples long, " + ", ".join(f"{c} double" for c in NOISE))

    def privacy_report(self) -> str:
        self.model  # noqa: B018
        head = [f"epsilon {self.epsilon}, delta {self.delta}, clip bound {self.clip_bound:.6f}, parties {len(self.noise_info)}"]
        return "\n".join(head + [f"  {x['party']}: n {x['n_samples']}, covariance SNR {x['snr_cov']:.4f}, mean SNR {x['snr_mean']:.4f}" for x in self.noise_info])


NOISE = ("mean_noise_scale", "cov_noise_scale", "mean_noise_norm", "cov_noise_norm", "snr_mean", "snr_cov")


def privacy_tradeoff(spark: SparkSession, samples: DataFrame, k: int, epsilons: list[float], delta: float = 1e-5, trials: int = 5, seed: int = 42, bound: float | None = None) -> DataFrame:
    """(epsilon, mean_angle, std_angle, snr_mean, snr_cov): angles in degrees to the model without noise.

    The bound and the clipped statistics are computed once; trials repeat only the noise.
    """
    from .estimators import PooledCovariance
    from .metrics import principal_angles

    bound = bound or clip_bound(samples)
    truth = PooledCovariance(k).fit(samples).model
    draws = [(eps, np.random.RandomState(seed + t)) for eps in epsilons for t in range(trials)]
    totals: list[Moments | None] = [None] * len(draws)
    snrs: list[list[tuple[float, float]]] = [[] for _ in draws]
    for row in party_stats(clip(samples, bound)).orderBy("party").toLocalIterator():  # one party at a time
        party = as_moments(row)
        for j, (eps, rng) in enumerate(draws):
            m, info = noisy(party, bound, eps, delta, rng)
            totals[j] = m if totals[j] is None else totals[j].merge(m)
            snrs[j].append((info["snr_mean"], info["snr_cov"]))
    rows = []
    for i, eps in enumerate(epsilons):
        own = range(i * trials, (i + 1) * trials)
        angles = [float(np.degrees(principal_angles(truth.components, private_model([totals[j]], k).components)).mean()) for j in own]
        rows.append((float(eps), float(np.mean(angles)), float(np.std(angles)), *map(float, np.mean([x for j in own for x in snrs[j]], axis=0))))
    return spark.createDataFrame(rows, "epsilon double, mean_angle double, std_angle double, snr_mean double, snr_cov double")


def sample_size_sweep(spark: SparkSession, samples: DataFrame, k: int, sizes: list[int], epsilon: float = 1.0, delta: float = 1e-5, trials: int = 5, seed: int = 42) -> DataFrame:
    """privacy_tradeoff() at one epsilon on samples of several sizes: (n, epsilon, mean_angle, ...). Rows are chosen by hash, smaller samples inside larger ones."""
    out = None
    for n in sizes:
        part = privacy_tradeoff(spark, sample_rows(samples, n, seed), k, [epsilon], delta, trials, seed).select(F.lit(n).alias("n"), "*")
        out = part if out is None else out.unionByName(part)
    return out

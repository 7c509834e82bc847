"""Short runs that show an operator at work: each returns a frame of what happened, step by step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compression, privacy
from ..operators.estimators import estimator
from ..operators.metrics import principal_angles
from ..operators.stats import party_stats
from ..sources import generate
from ..streaming.incremental import StreamingPCA
from .experiment import scorecard


def streaming(spark: SparkSession, k: int = 5) -> DataFrame:
    """(step, action, n_clients, n_samples, explained): three parties come, one grows, one is replaced, one goes."""
    rows = generate.block_parties(spark, [500, 600, 400, 300], 40)
    own = lambda p: rows.where(F.col("party") == p)
    run, out = StreamingPCA(k), []
    steps = [("add 0", lambda: run.add_client("0", own(0))), ("add 1", lambda: run.add_client("1", own(1))), ("add 2", lambda: run.add_client("2", own(2))), ("append to 0", lambda: run.update_client("0", own(3), "append")), ("replace 1", lambda: run.update_client("1", own(3), "replace")), ("remove 2", lambda: run.remove_client("2"))]
    for at, (what, step) in enumerate(steps):
        step()
        s = run.status(spark).first()
        out.append((at, what, s["n_clients"], s["n_samples"], s["explained"]))
    return spark.createDataFrame(out, "step int, action string, n_clients int, n_samples long, explained double")


def private(spark: SparkSession, k: int = 3, epsilons: tuple[float, ...] = (0.5, 1.0, 5.0, 10.0)) -> DataFrame:
    """(epsilon, mean_angle, std_angle, snr_mean, snr_cov) on generated parties."""
    return privacy.privacy_tradeoff(spark, generate.normal_parties(spark, 3, 400, 12), k, list(epsilons), trials=3)


def compressed(spark: SparkSession, k: int = 5) -> DataFrame:
    """(method, params, mean_angle, compression_ratio, kilobytes), the smallest message first."""
    rows = generate.block_parties(spark, [300, 300, 300], 60)
    configs = [("none", {}), ("low_rank", {"rank": 10}), ("quantize", {"bits": 8}), ("sketch", {"sketch": 40}), ("top_k", {"top_k": 500}), ("combined", {"rank": 10, "bits": 16})]
    return compression.evaluate_compression(spark, rows, party_stats(rows), k, configs).orderBy(F.desc("compression_ratio"))


def methods(spark: SparkSession, k: int = 5) -> DataFrame:
    """The scorecard of all methods on parties of opposite patterns."""
    rows = generate.block_parties(spark, [500, 600, 400], 40)
    return scorecard(spark, rows, None, k, classify=False)


def agreement(spark: SparkSession, k: int = 5) -> DataFrame:
    """(method, angle): the largest angle in degrees between each method's space and the pooled one."""
    rows = generate.blobs(spark, 2000, 30).withColumn("party", (F.col("row_id") % 5).cast("int"))
    truth = estimator("P-COV", k).fit(rows).model
    out = [(m, float(np.degrees(principal_angles(truth.components, estimator(m, k, 1).fit(rows).model.components)).max())) for m in ("P-COV", "AP-COV", "QR-PCA", "SUB-IT")]
    return spark.createDataFrame(out, "method string, angle double")


DEMOS = {f.__name__: f for f in (streaming, private, compressed, methods, agreement)}

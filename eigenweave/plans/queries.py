"""Queries over the driver's tables, and the DuckDB SQL that says what each returns.

The fixture with closed forms is lineitem in two features: party 0, 1, 2 by supplier number, x =
quantity / 10 + 3 * party, y = price / 10000 + quantity / 10. A symmetric 2 x 2 matrix has its
eigenpairs in SQL arithmetic, so estimators, projections, compression and metrics have SQL twins.
Values are rounded, and + 0.0 removes negative zeros.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as sql_functions
from ..operators import adaptive, combine, compression, downstream, metrics, privacy
from ..operators.estimators import estimator
from ..operators.model import PCAModel
from ..operators.stats import covariances, party_stats
from ..sources import generate, images, samples as src
from ..sources.partition import DataPartitioner, partition_stats
from ..sources.scratch import scratch
from ..sources.sinks import put_bytes, read_csv, results_frame, text_report, write
from ..streaming import events as stream
from ..streaming.incremental import StreamingPCA
from . import demos, experiment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str, features: bool = True) -> DataFrame:
    """The two-feature fixture as samples; label = line number."""
    part = F.when(F.col("l_suppkey") % 10 < 5, 0).when(F.col("l_suppkey") % 10 < 8, 1).otherwise(2)
    x = F.col("l_quantity") / 10 + 3 * part
    y = F.col("l_extendedprice") / 10000 + F.col("l_quantity") / 10
    return src.samples(table(spark, sf, "lineitem"), [x, y], part, F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_linenumber")


def embeddings(spark: SparkSession, sf: str, parties: int = 5) -> DataFrame:
    return src.load(spark, sf, "embeddings", (F.col("vec_id") % parties).cast("int"))


def numbers(spark: SparkSession, **values: float) -> DataFrame:
    """One row of rounded doubles."""
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in values.values())], ", ".join(f"{k} double" for k in values))


def components(spark: SparkSession, m: PCAModel) -> DataFrame:
    f = m.frame(spark)
    return f.select("idx", r("eigenvalue").alias("eigenvalue"), r("ratio").alias("ratio"), r("ratio_kept").alias("ratio_kept"), r(F.col("loadings")[0]).alias("w0"), r(F.col("loadings")[1]).alias("w1"))


#: SQL text shared by the oracles.
BASE = """
samples AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_linenumber AS label, party, l_quantity / 10 + 3 * party AS x, l_extendedprice / 10000 + l_quantity / 10 AS y
  FROM (SELECT *, CASE WHEN l_suppkey % 10 < 5 THEN 0 WHEN l_suppkey % 10 < 8 THEN 1 ELSE 2 END AS party FROM lineitem)),
stats AS (SELECT party, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM samples GROUP BY party),
tot AS (SELECT sum(n) AS nn, count(*) AS kk, sum(n * mx) / sum(n) AS gx, sum(n * my) / sum(n) AS gy FROM stats)"""
POOLED = "SELECT gx AS mx, gy AS my, sum(n * (a + (mx - gx) ** 2)) / nn AS a, sum(n * (b + (mx - gx) * (my - gy))) / nn AS b, sum(n * (c + (my - gy) ** 2)) / nn AS c FROM stats, tot GROUP BY gx, gy, nn"
AVERAGED = "SELECT gx AS mx, gy AS my, sum(n * a) / nn AS a, sum(n * b) / nn AS b, sum(n * c) / nn AS c FROM stats, tot GROUP BY gx, gy, nn"
PLAIN_AVERAGE = "SELECT gx AS mx, gy AS my, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM stats, tot GROUP BY gx, gy"


def eig(name: str, matrix: str) -> str:
    """CTEs from a one-row matrix (mx, my, a, b, c) to `name` with l1, l2 and the canonical first axis (u, v)."""
    return f"""{name}_m AS ({matrix}),
{name}_e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM {name}_m),
{name}_u AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS u0, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS v0 FROM {name}_e),
{name} AS (SELECT *, u0 * s AS u, v0 * s AS v FROM (SELECT *, CASE WHEN round(abs(u0), 12) >= round(abs(v0), 12) THEN sign(u0) ELSE sign(v0) END AS s FROM {name}_u))"""


def first_axis(matrix: str, value: str = "l1", ratio: str = "l1 / (a + c)") -> str:
    return f"WITH {BASE}, {eig('p', matrix)} SELECT CAST(0 AS INTEGER) AS idx, round({value}, 6) + 0.0 AS eigenvalue, round({ratio}, 6) + 0.0 AS ratio, CAST(1 AS DOUBLE) AS ratio_kept, round(u, 6) + 0.0 AS w0, round(v, 6) + 0.0 AS w1 FROM p"


BOTH_AXES = f"""WITH {BASE}, {eig('p', POOLED)},
q AS (SELECT 0 AS idx, l1 AS l, l1 + l2 AS t, u AS w0, v AS w1 FROM p UNION ALL SELECT 1, l2, l1 + l2, -v * g, u * g FROM (SELECT *, CASE WHEN round(abs(v), 12) >= round(abs(u), 12) THEN sign(-v) ELSE sign(u) END AS g FROM p))
SELECT CAST(idx AS INTEGER) AS idx, round(l, 6) + 0.0 AS eigenvalue, round(l / t, 6) + 0.0 AS ratio, round(l / t, 6) + 0.0 AS ratio_kept, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1 FROM q"""


# A, C: estimators


@query(f"WITH {BASE} SELECT party, n, round(mx, 6) + 0.0 AS m0, round(my, 6) + 0.0 AS m1, round(a, 6) + 0.0 AS c00, round(b, 6) + 0.0 AS c01, round(c, 6) + 0.0 AS c11 FROM stats")
def a3_party_stats(spark, sf):
    s = party_stats(lineitem(spark, sf))
    cell = lambda k: r(F.col("m2")[k] / F.col("n"))
    return s.select("party", "n", r(F.col("mean")[0]).alias("m0"), r(F.col("mean")[1]).alias("m1"), cell(0).alias("c00"), cell(1).alias("c01"), cell(2).alias("c11"))


@query(BOTH_AXES)
def c1_centralized(spark, sf):
    return components(spark, estimator("Centralized", 2).fit(lineitem(spark, sf)).model)


@query("WITH " + BASE + ", s AS (SELECT * FROM samples WHERE party = 1), " + eig("p", "SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM s") + " SELECT CAST(0 AS INTEGER) AS idx, round(l1, 6) + 0.0 AS eigenvalue, round(l1 / (a + c), 6) + 0.0 AS ratio, CAST(1 AS DOUBLE) AS ratio_kept, round(u, 6) + 0.0 AS w0, round(v, 6) + 0.0 AS w1 FROM p")
def c2_fit_single(spark, sf):
    return components(spark, estimator("Centralized", 1).fit(lineitem(spark, sf).where("party = 1")).model)


@query(BOTH_AXES)
def c3_pcov(spark, sf):
    return components(spark, estimator("P-COV", 2).fit(lineitem(spark, sf)).model)


@query(first_axis(AVERAGED))
def c4_apcov(spark, sf):
    return components(spark, estimator("AP-COV", 1).fit(lineitem(spark, sf)).model)


@query(first_axis(PLAIN_AVERAGE))
def c4_apcov_unweighted(spark, sf):
    return components(spark, estimator("AP-COV", 1, weighted=False).fit(lineitem(spark, sf)).model)


LOCAL = """le AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS e1 FROM stats),
lu AS (SELECT *, b / sqrt(b * b + (e1 - a) ** 2) AS p, (e1 - a) / sqrt(b * b + (e1 - a) ** 2) AS q FROM le)"""


@query(f"WITH {BASE}, {LOCAL}, whole AS ({POOLED}), {eig('p', 'SELECT gx AS mx, gy AS my, sum(e1 * p * p) AS a, sum(e1 * p * q) AS b, sum(e1 * q * q) AS c FROM lu, tot GROUP BY gx, gy')} SELECT CAST(0 AS INTEGER) AS idx, round(l1 / kk, 6) + 0.0 AS eigenvalue, round(l1 / kk / (whole.a + whole.c), 6) + 0.0 AS ratio, CAST(1 AS DOUBLE) AS ratio_kept, round(u, 6) + 0.0 AS w0, round(v, 6) + 0.0 AS w1 FROM p, tot, whole")
def c5_apstack(spark, sf):
    return components(spark, estimator("AP-STACK", 1).fit(lineitem(spark, sf)).model)


QR = "SELECT gx AS mx, gy AS my, sum({w} * n * (a + (mx - gx) ** 2)) / nn AS a, sum({w} * n * (b + (mx - gx) * (my - gy))) / nn AS b, sum({w} * n * (c + (my - gy) ** 2)) / nn AS c FROM stats, tot GROUP BY gx, gy, nn"


@query(f"WITH {BASE}, whole AS ({POOLED}), {eig('p', QR.format(w='n / nn'))} SELECT CAST(0 AS INTEGER) AS idx, round(l1, 6) + 0.0 AS eigenvalue, round(l1 / (whole.a + whole.c), 6) + 0.0 AS ratio, CAST(1 AS DOUBLE) AS ratio_kept, round(u, 6) + 0.0 AS w0, round(v, 6) + 0.0 AS w1 FROM p, whole")
def c6_qr(spark, sf):
    return components(spark, estimator("QR-PCA", 1).fit(lineitem(spark, sf)).model)


@query(first_axis(POOLED))
def c6_qr_exact(spark, sf):
    return components(spark, estimator("QR-PCA", 1, weighting="exact").fit(lineitem(spark, sf)).model)


@query(first_axis(POOLED))
def c7_subspace_iteration(spark, sf):
    return components(spark, estimator("SUB-IT", 1, 7, max_iter=500, tol=1e-10).fit(lineitem(spark, sf)).model)


EMBED = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, CAST(vec_id % 5 AS INTEGER) AS party FROM embeddings)"


@query("""WITH e AS (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS v FROM s a JOIN s b USING (vec_id) GROUP BY a.i, b.i)
SELECT round(sum(CASE WHEN i = j THEN v ELSE 0 END), 6) + 0.0 AS trace, round(sum(v * v), 6) + 0.0 AS sum_of_squares, round(sum(CASE WHEN i = j THEN v ELSE 0 END), 6) + 0.0 AS sum_eigenvalues, round(sum(v * v), 6) + 0.0 AS sum_squared_eigenvalues FROM c""")
def c3_pcov_embeddings(spark, sf):
    """64 features: trace and Frobenius norm of the pooled covariance equal the spectrum's sums."""
    m = combine.pooled_moments(party_stats(embeddings(spark, sf)))
    values = combine.from_covariance(m.mean, m.cov, 64, m.n).explained_variance
    return numbers(spark, trace=np.trace(m.cov), sum_of_squares=(m.cov**2).sum(), sum_eigenvalues=values.sum(), sum_squared_eigenvalues=(values**2).sum())


@query("WITH " + EMBED + ", s AS (SELECT party, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) SELECT a.party, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS value FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.party, a.i, b.i")
def a3_party_covariances(spark, sf):
    return covariances(party_stats(embeddings(spark, sf))).select("party", "i", "j", r("value").alias("value"))


SCORES = f"WITH {BASE}, {eig('p', POOLED)}, z AS (SELECT samples.*, (x - mx) * u + (y - my) * v AS z, mx, my, u, v FROM samples, p)"


@query(SCORES + " SELECT row_id, party, round(z, 4) + 0.0 AS score FROM z")
def a5_transform(spark, sf):
    s = lineitem(spark, sf)
    return estimator("P-COV", 1).fit(s).transform(s).select("row_id", "party", r(F.col("scores")[0], 4).alias("score"))


@query(SCORES + " SELECT row_id, round(mx + z * u, 4) + 0.0 AS x0, round(my + z * v, 4) + 0.0 AS x1 FROM z")
def a6_inverse_transform(spark, sf):
    s = lineitem(spark, sf)
    est = estimator("P-COV", 1).fit(s)
    out = est.inverse_transform(est.transform(s))
    return out.select("row_id", r(F.col("restored")[0], 4).alias("x0"), r(F.col("restored")[1], 4).alias("x1"))


@query(SCORES + " SELECT party, count(*) AS n, round(avg(z), 6) + 0.0 AS mean, round(var_pop(z), 6) + 0.0 AS variance FROM z GROUP BY party")
def a7_fit_transform(spark, sf):
    out = estimator("P-COV", 1).fit_transform(lineitem(spark, sf)).withColumn("z", F.col("scores")[0])
    return out.groupBy("party").agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("mean"), r(F.var_pop("z")).alias("variance"))


@query("SELECT * FROM (VALUES ('AP-COV', 1, 33280, 166400), ('AP-STACK', 1, 4096, 20480), ('Centralized', 0, 0, 0), ('P-COV', 2, 33280, 166400), ('QR-PCA', 1, 8192, 40960)) AS t(method, rounds, bytes_per_party, total_bytes)")
def a8_communication_cost(spark, sf):
    """5 parties, 64 features, 8 components."""
    s = embeddings(spark, sf)
    stats = party_stats(s).persist(StorageLevel.MEMORY_AND_DISK)
    rows = [(m, *(estimator(m, 8).fit(s, stats).communication_cost()[k] for k in ("rounds", "bytes_per_party", "total_bytes"))) for m in ("AP-COV", "AP-STACK", "Centralized", "P-COV", "QR-PCA")]
    stats.unpersist()
    return spark.createDataFrame(rows, "method string, rounds int, bytes_per_party int, total_bytes int")


@query("SELECT * FROM (VALUES ('fit on no rows', true), ('no components', true), ('transform before fit', true), ('unknown method', true)) t(what, raised)")
def a9_guards(spark, sf):
    """What raises ValueError."""
    s = lineitem(spark, sf)
    tries = {"transform before fit": lambda: estimator("P-COV", 2).transform(s), "no components": lambda: estimator("P-COV", 0), "unknown method": lambda: estimator("?", 2), "fit on no rows": lambda: estimator("P-COV", 2).fit(s.where("false"))}
    rows = []
    for what, f in tries.items():
        try:
            f()
            rows.append((what, False))
        except ValueError:
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, raised boolean")


# B: sources and partitions

U = "CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':{seed}'), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query("SELECT CAST(party AS INTEGER) AS party, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM (SELECT vec_id, floor(" + U.format(seed=42) + " * 7) AS party FROM embeddings) GROUP BY party")
def b5_iid_partition(spark, sf):
    return _parties(DataPartitioner(7).partition(embeddings(spark, sf), "iid"))


@query("SELECT CAST(party AS INTEGER) AS party, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM (SELECT vec_id, (row_number() OVER (ORDER BY " + U.format(seed=42) + ", vec_id) - 1) % 7 AS party FROM embeddings) GROUP BY party")
def b5_iid_exact(spark, sf):
    return _parties(DataPartitioner(7).partition(embeddings(spark, sf), "iid", exact=True))


def _parties(parted: DataFrame) -> DataFrame:
    return parted.groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def _dirichlet_sql() -> str:
    shares = DataPartitioner(4).dirichlet_shares(list(range(10)), 0.5)
    values = ", ".join(f"({x}, [{', '.join(repr(float(c)) for c in np.cumsum(s)[:-1])}])" for x, s in shares.items())
    return f"WITH cuts AS (SELECT * FROM (VALUES {values}) AS t(label, c)), p AS (SELECT vec_id, least(len(list_filter(c, lambda s: s <= {U.format(seed=42)})), 3) AS party FROM embeddings JOIN cuts USING (label)) SELECT CAST(party AS INTEGER) AS party, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM p GROUP BY party"


@query(_dirichlet_sql())
def b6_dirichlet_partition(spark, sf):
    return _parties(DataPartitioner(4).partition(embeddings(spark, sf), "dirichlet", alpha=0.5))


def _shard_sql() -> str:
    deal = ", ".join(str(int(x) // 2) for x in np.random.RandomState(42).permutation(8))
    return f"""WITH l AS (SELECT label, count(*) AS c, sum(count(*)) OVER (ORDER BY label) - count(*) AS before, sum(count(*)) OVER () AS n FROM embeddings GROUP BY label),
p AS (SELECT vec_id, [{deal}][1 + CAST(least(floor((before / n + {U.format(seed=42)} * (c / n)) * 8), 7) AS INTEGER)] AS party FROM embeddings JOIN l USING (label))
SELECT CAST(party AS INTEGER) AS party, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM p GROUP BY party"""


@query(_shard_sql())
def b7_shard_partition(spark, sf):
    return _parties(DataPartitioner(4).partition(embeddings(spark, sf), "shard", shards_per_client=2))


def _shard_exact_sql() -> str:
    deal = ", ".join(str(int(x) // 2) for x in np.random.RandomState(42).permutation(8))
    return f"WITH k AS (SELECT vec_id, row_number() OVER (ORDER BY label IS NULL, label, {U.format(seed=42)}, vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings) SELECT CAST([{deal}][1 + CAST(least(k * 8 // n, 7) AS INTEGER)] AS INTEGER) AS party, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM k GROUP BY 1"


@query(_shard_exact_sql())
def b7_shard_exact(spark, sf):
    return _parties(DataPartitioner(4).partition(embeddings(spark, sf), "shard", shards_per_client=2, exact=True))


def _quantity_sql() -> str:
    cuts = ", ".join(repr(float(x)) for x in np.cumsum(DataPartitioner(5).quantity_shares(1.5))[:-1])
    return f"SELECT CAST(party AS INTEGER) AS party, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM (SELECT vec_id, len(list_filter([{cuts}], lambda s: s <= {U.format(seed=42)})) AS party FROM embeddings) GROUP BY party"


@query(_quantity_sql())
def b8_quantity_skew_partition(spark, sf):
    return _parties(DataPartitioner(5).partition(embeddings(spark, sf), "quantity_skew", power=1.5))


@query("""WITH e AS (SELECT vec_id % 5 AS party, label FROM embeddings), cells AS (SELECT party, label, count(*) AS n FROM e GROUP BY party, label), sizes AS (SELECT party, sum(n) AS size FROM cells GROUP BY party),
labels AS (SELECT label, sum(n) / (SELECT count(*) FROM e) AS share FROM cells GROUP BY label),
emd AS (SELECT party, sum(abs(coalesce(n, 0) / size - share)) AS emd FROM sizes CROSS JOIN labels LEFT JOIN cells USING (party, label) GROUP BY party)
SELECT count(*) AS n_parties, CAST(min(size) AS BIGINT) AS min_samples, CAST(max(size) AS BIGINT) AS max_samples, round(avg(size), 6) + 0.0 AS mean_samples, round(avg(emd), 6) + 0.0 AS mean_emd FROM sizes JOIN emd USING (party)""")
def b9_partition_stats(spark, sf):
    return partition_stats(embeddings(spark, sf)).select("n_parties", "min_samples", "max_samples", r("mean_samples").alias("mean_samples"), r("mean_emd").alias("mean_emd"))


@query("SELECT 'class ' || CAST(k AS VARCHAR) AS class_name, CAST(k AS INTEGER) AS class_id, 'embeddings' AS dataset FROM range(10) t(k)")
def b3_dataset_info(spark, sf):
    return src.dataset_info(spark, "embeddings")


@query("SELECT CAST(i AS BIGINT) AS row_id, CAST(i % 3 AS INTEGER) AS label, round(list_sum([((i * 37 + j * 11) % 256) / 255 for j in range(12)]), 6) + 0.0 AS ink, CAST(12 AS INTEGER) AS d FROM range(500) t(i)")
def b1_idx_images(spark, sf):
    """A gzipped IDX pair, written by a rule, as samples."""
    import gzip
    import struct

    folder = scratch(spark, "idx")
    x = (np.arange(500)[:, None] * 37 + np.arange(12)[None, :] * 11) % 256
    put_bytes(spark, f"{folder}/images.gz", gzip.compress(struct.pack(">4B3I", 0, 0, 8, 3, 500, 3, 4) + x.astype(np.uint8).tobytes()))
    put_bytes(spark, f"{folder}/labels", struct.pack(">4BI", 0, 0, 8, 1, 500) + (np.arange(500) % 3).astype(np.uint8).tobytes())
    got = images.load_idx(spark, f"{folder}/images.gz", f"{folder}/labels")
    return got.select("row_id", "label", r(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("ink"), F.size("features").alias("d"))


@query("SELECT CAST(f * 4294967296 + i AS BIGINT) AS row_id, CAST((f * 7 + i) % 10 AS INTEGER) AS label, CAST(list_sum([(f * 101 + i * 31 + j) % 256 for j in range(3072)]) AS DOUBLE) AS ink FROM range(2) a(f), range(20) b(i)")
def b2_image_records(spark, sf):
    """Two files of binary records of a label and 3072 pixels, written by a rule, as samples."""
    folder = scratch(spark, "records")
    for f in range(2):
        rows = [bytes([(f * 7 + i) % 10]) + ((f * 101 + i * 31 + np.arange(3072)) % 256).astype(np.uint8).tobytes() for i in range(20)]
        put_bytes(spark, f"{folder}/batch_{f}.bin", b"".join(rows))
    got = images.load_records(spark, folder, normalize=False)
    return got.select("row_id", "label", F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("ink"))


def _made(frame: DataFrame) -> DataFrame:
    return frame.groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d"), F.countDistinct("label").alias("classes"))


@query("SELECT 0 AS party, 5000 AS n, 100 AS d, 10 AS classes")
def b10_blobs(spark, sf):
    return _made(generate.blobs(spark))


@query("SELECT 0 AS party, 2000 AS n, 196 AS d, 10 AS classes")
def b11_image_like(spark, sf):
    return _made(generate.image_like(spark, 2000, 196))


@query("SELECT * FROM (VALUES (0, 500, 100, 1), (1, 600, 100, 1), (2, 400, 100, 1)) t(party, n, d, classes)")
def b12_block_parties(spark, sf):
    return _made(generate.block_parties(spark, [500, 600, 400], 100))


@query("SELECT CAST(k AS INTEGER) AS party, 100 AS n, 50 AS d, 1 AS classes FROM range(5) t(k)")
def b15_normal_parties(spark, sf):
    return _made(generate.normal_parties(spark))


@query(f"WITH {BASE} SELECT party, round(avg(x + 2 * party), 6) + 0.0 AS m0, round(avg(y + 2 * party), 6) + 0.0 AS m1 FROM samples GROUP BY party")
def b16_mean_shift(spark, sf):
    s = src.mean_shifted(lineitem(spark, sf))
    return s.groupBy("party").agg(r(F.avg(F.col("features")[0])).alias("m0"), r(F.avg(F.col("features")[1])).alias("m1"))


@query(f"WITH {BASE} SELECT party, count(*) AS n, round(avg((x - gx) / (sx + 1e-8)), 6) + 0.0 AS m0, round(stddev_pop((y - gy) / (sy + 1e-8)), 6) + 0.0 AS s1 FROM samples, (SELECT avg(x) AS gx, stddev_pop(x) AS sx, avg(y) AS gy, stddev_pop(y) AS sy FROM samples) GROUP BY party")
def i8_zscore(spark, sf):
    (z,) = src.zscore(lineitem(spark, sf))
    return z.groupBy("party").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("features")[0])).alias("m0"), r(F.stddev_pop(F.col("features")[1])).alias("s1"))


@query("SELECT CAST(vec_id % 5 AS INTEGER) AS party, label, count(*) AS n FROM embeddings GROUP BY 1, 2")
def i10_label_histogram(spark, sf):
    return src.label_histogram(embeddings(spark, sf))


@query("SELECT 200 AS n, 200 AS ids")
def i11_sample_rows(spark, sf):
    return src.sample_rows(embeddings(spark, sf), 200, 1).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"))


@query("SELECT party, count(*) AS n FROM (SELECT vec_id % 5 AS party FROM embeddings UNION ALL SELECT vec_id % 5 FROM embeddings WHERE label = 3) GROUP BY party")
def i9_pooled(spark, sf):
    s = embeddings(spark, sf)
    return src.pooled(s, s.where("label = 3")).groupBy(F.col("party").cast("long").alias("party")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('iid', 'angle', 0.01::DOUBLE), ('shard', 'angle', 1.04), ('shard', 'accuracy', 0.95)) t(path, metric, value)")
def b17_csv_sink(spark, sf):
    """Nested results flattened, written as CSV and read back."""
    path = scratch(spark, "csv")
    write(results_frame(spark, {"iid": {"angle": 0.01}, "shard": {"angle": 1.04, "accuracy": 0.95}}), path, "csv")
    return read_csv(spark, path, "path string, metric string, value double")


@query(f"WITH {BASE} SELECT CAST(0 AS INTEGER) AS line_no, 'heterogeneity medium' AS head, count(*) AS lines FROM range(11) GROUP BY 1, 2")
def b19_report(spark, sf):
    lines = text_report(spark, adaptive.Adaptive(1).fit(lineitem(spark, sf)).selection_report())
    n = lines.count()
    return lines.where("line_no = 0").select("line_no", F.regexp_extract("line", "^(heterogeneity [a-z]+)", 1).alias("head"), F.lit(n).cast("long").alias("lines"))


# D: adaptive

DIVERGE = f"""WITH {BASE}, avgc AS ({AVERAGED}), w AS (SELECT s.*, nn, kk, sqrt((mx - gx) ** 2 + (my - gy) ** 2) AS far,
  sqrt((s.a - g.a) ** 2 + 2 * (s.b - g.b) ** 2 + (s.c - g.c) ** 2) AS cfar, g.a + g.c AS tr, sqrt(g.a ** 2 + 2 * g.b ** 2 + g.c ** 2) AS norm FROM stats s, tot, (SELECT a, b, c FROM avgc) g),
m AS (SELECT sum(n * far) / max(nn) AS md, max(far) AS mdmax, sum(n * far) / max(nn) / (sqrt(max(tr) / 2 + 1e-8) * sqrt(2)) AS mdn, sum(n * cfar) / max(nn) AS cd, sum(n * cfar) / max(nn) / (max(norm) + 1e-8) AS cdn,
  stddev_pop(n) / avg(n) AS cv, max(n) / (min(n) + 1.0) AS imb, sum(n * abs(a + c - tr) / (tr + 1e-8)) / max(nn) AS vd FROM w),
s AS (SELECT *, least(1, .25 * least(1, 3 * mdn) + .45 * least(1, 1.5 * cdn) + .1 * least(1, 5 * vd)) AS score FROM m)"""


@query(DIVERGE + " SELECT round(md, 6) AS mean_divergence, round(mdmax, 6) AS mean_divergence_max, round(mdn, 6) AS mean_divergence_normalized, round(cd, 6) AS cov_divergence, round(cdn, 6) AS cov_divergence_normalized, round(cv, 6) AS sample_cv, round(imb, 6) AS sample_imbalance, CAST(0 AS DOUBLE) AS spectrum_divergence, round(vd, 6) AS variance_divergence, round(score, 6) AS score FROM s")
def d2_heterogeneity(spark, sf):
    found = adaptive.heterogeneity(party_stats(lineitem(spark, sf)), 50)
    return numbers(spark, **found["metrics"], score=found["score"])


@query(DIVERGE + f", {eig('g', POOLED)}, {eig('h', AVERAGED)} SELECT CASE WHEN score < .15 THEN 'low' WHEN score < .35 THEN 'medium' ELSE 'high' END AS level, CASE WHEN score >= .35 THEN 'P-COV' ELSE 'AP-COV' END AS method, round(CASE WHEN score >= .35 THEN g.l1 ELSE h.l1 END, 6) + 0.0 AS eigenvalue FROM s, g, h")
def d5_adaptive_fit(spark, sf):
    est = adaptive.Adaptive(1).fit(lineitem(spark, sf))
    return spark.createDataFrame([(est.detected["level"], est.chosen.name, round(float(est.model.explained_variance[0]), 6))], "level string, method string, eigenvalue double")


ANGLE = f"WITH {BASE}, {eig('p', POOLED)}, {eig('q', AVERAGED)}, d AS (SELECT abs(p.u * q.u + p.v * q.v) AS cos, abs(p.u * q.v - p.v * q.u) AS sin FROM p, q)"


@query(ANGLE + " SELECT 'AP-COV' AS method, round(degrees(asin(sin)), 6) + 0.0 AS mean_angle FROM d UNION ALL SELECT 'P-COV', 0.0")
def d7_evaluate_selection(spark, sf):
    s = lineitem(spark, sf)
    out = adaptive.evaluate_selection(spark, s, party_stats(s), 1)
    return out.where("method in ('P-COV', 'AP-COV')").select("method", r("mean_angle").alias("mean_angle"))


# E: incremental


def _pooled_over(where: str, extra: str = "") -> str:
    return f"WITH {BASE}, s AS (SELECT * FROM samples WHERE {where} {extra}), " + eig("p", "SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM s") + " SELECT CAST(0 AS INTEGER) AS idx, round(l1, 6) + 0.0 AS eigenvalue, round(l1 / (a + c), 6) + 0.0 AS ratio, CAST(1 AS DOUBLE) AS ratio_kept, round(u, 6) + 0.0 AS w0, round(v, 6) + 0.0 AS w1 FROM p"


@query(_pooled_over("true"))
def e2_streaming_fit(spark, sf):
    return components(spark, StreamingPCA(1).fit(lineitem(spark, sf)).model)


@query(_pooled_over("party <> 1"))
def e5_remove_client(spark, sf):
    return components(spark, StreamingPCA(1).fit(lineitem(spark, sf)).remove_client("1").model)


@query(_pooled_over("party IN (0, 2)", "OR (party = 1 AND label > 3)"))
def e4_update_replace(spark, sf):
    s = lineitem(spark, sf)
    return components(spark, StreamingPCA(1).fit(s).update_client("1", s.where("party = 1 and label > 3"), "replace").model)


@query(_pooled_over("party IN (0, 1)"))
def e4_update_append(spark, sf):
    s = lineitem(spark, sf)
    first = s.where("party = 0 or (party = 1 and label <= 3)")
    return components(spark, StreamingPCA(1).fit(first).update_client("1", s.where("party = 1 and label > 3"), "append").model)


@query(f"WITH {BASE} SELECT CAST(party AS VARCHAR) AS client_id, round(n / nn, 6) + 0.0 AS contribution FROM stats, tot")
def e11_contribution(spark, sf):
    s = StreamingPCA(1).fit(lineitem(spark, sf))
    return spark.createDataFrame([(c, round(s.contribution(c), 6)) for c in s.clients], "client_id string, contribution double")


@query("SELECT * FROM (VALUES ('add', '0', 1), ('add', '1', 2), ('add', '2', 3), ('remove', '1', 4)) t(action, client_id, seq)")
def e10_history(spark, sf):
    return StreamingPCA(1).fit(lineitem(spark, sf)).remove_client("1").history_frame(spark).select("action", "client_id", F.col("seq").cast("int").alias("seq"))


@query(f"WITH {BASE} SELECT n, round(mx, 6) + 0.0 AS m0, round(my, 6) + 0.0 AS m1, round(a, 6) + 0.0 AS c00, round(b, 6) + 0.0 AS c01, round(c, 6) + 0.0 AS c11 FROM stats WHERE party = 1")
def e1_client_state(spark, sf):
    """One client's rows as the state that is kept of it."""
    m = StreamingPCA.statistics(lineitem(spark, sf).where("party = 1"))
    return spark.createDataFrame([(m.n, *(round(float(x), 6) for x in (*m.mean, m.cov[0, 0], m.cov[0, 1], m.cov[1, 1])))], "n long, m0 double, m1 double, c00 double, c01 double, c11 double")


@query(_pooled_over("party <> 1 OR label <= 3"))
def e8_recompute(spark, sf):
    """Adds, an append, a replacement, removals; every second change rebuilds the global moments from the clients'."""
    s = lineitem(spark, sf)
    own = lambda p: s.where(F.col("party") == p)
    run = StreamingPCA(1, threshold=2).add_client("2", own(2)).add_client("0", own(1)).add_client("x", own(2)).update_client("0", own(0), "replace")
    run = run.add_client("1", own(1).where("label > 3")).remove_client("x").update_client("1", own(1).where("label <= 3"), "replace")
    return components(spark, run.model)


@query(_pooled_over("true"))
def e9_aggregate(spark, sf):
    """A federation replaced by a statistics table."""
    s = lineitem(spark, sf)
    return components(spark, StreamingPCA(1).add_client("old", s.where("party = 0")).aggregate(party_stats(s)).model)


@query(f"WITH {BASE}, {eig('p', 'SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM samples WHERE party <> 1')} SELECT CAST(2 AS INTEGER) AS n_clients, (SELECT count(*) FROM samples WHERE party <> 1) AS n_samples, CAST(2 AS INTEGER) AS n_features, CAST(1 AS INTEGER) AS n_components, true AS fitted, CAST(4 AS BIGINT) AS update_counter, CAST(1 AS BIGINT) AS since_recompute, round(l1 / (a + c), 6) + 0.0 AS explained FROM p")
def e10_status(spark, sf):
    return StreamingPCA(1).fit(lineitem(spark, sf)).remove_client("1").status(spark).withColumn("explained", r("explained"))


@query("SELECT CAST(step AS INTEGER) AS step, action, CAST(n_clients AS INTEGER) AS n_clients, CAST(n_samples AS BIGINT) AS n_samples FROM (VALUES (0, 'add 0', 1, 500), (1, 'add 1', 2, 1100), (2, 'add 2', 3, 1500), (3, 'append to 0', 3, 1800), (4, 'replace 1', 3, 1500), (5, 'remove 2', 2, 1100)) t(step, action, n_clients, n_samples)")
def e12_streaming_demo(spark, sf):
    return demos.streaming(spark).drop("explained")


EVENT_TABLE = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(EVENT_TABLE).option("pathGlobFilter", "events.parquet").parquet(sf)


CLIENT_EVENTS = "SELECT user_id % 4 AS client, value, ln(1 + value) AS y FROM events WHERE value IS NOT NULL"


@query(f"WITH e AS ({CLIENT_EVENTS}) SELECT CAST(client AS VARCHAR) AS client_id, count(*) AS n, round(avg(value), 6) + 0.0 AS m0, round(avg(y), 6) + 0.0 AS m1, round(covar_pop(value, y), 6) + 0.0 AS c01 FROM e GROUP BY client")
def e3_stream_of_events(spark, sf):
    """The events table as a stream of clients: the first 500 ids add the clients, each next 500 are appended."""
    path = scratch(spark, "stream")
    run_client_stream(event_stream(spark, sf), path)
    return client_table(spark, path)


def run_client_stream(events: DataFrame, path: str) -> None:
    chunk = F.floor(F.col("event_id") / 500)
    op = F.when(chunk == 0, "add").otherwise("update")
    mode = F.when(chunk > 0, "append").otherwise("")
    x = F.array(F.col("value"), F.log1p(F.col("value")))
    ev = events.where("value is not null").select(chunk.alias("seq"), op.alias("op"), mode.alias("mode"), (F.col("user_id") % 4).cast("string").alias("client_id"), x.alias("features"))
    stream.run_models(ev, 1, path, f"{path}-checkpoint").awaitTermination()


def client_table(spark: SparkSession, path: str) -> DataFrame:
    last = stream.current(spark, path)
    return last.select(F.col("party").alias("client_id"), "n", r(F.col("mean")[0]).alias("m0"), r(F.col("mean")[1]).alias("m1"), r(F.col("m2")[1] / F.col("n")).alias("c01"))


def _last_batch(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("batch")).first()[0]


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance FROM events GROUP BY 1, 2")
def e_windowed_moments(spark, sf):
    """Event-time windows with a watermark, each trigger's changed windows kept by key."""
    path = scratch(spark, "windows")
    agg = stream.windowed_moments(event_stream(spark, sf), "value")
    run = agg.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/batch={_last_batch(spark, path)}").select("start", "event_type", "n", r("mean").alias("mean"), r("variance").alias("variance"))


# F: privacy and compression


@query("SELECT 0.5 AS spent_epsilon, CAST(0.000005 AS DOUBLE) AS spent_delta, 0.5 AS remaining_epsilon, 1 AS refused")
def f1_accountant(spark, sf):
    a, refused = privacy.Accountant(1.0, 1e-5), 0
    a.spend(0.5, 5e-6)
    try:
        a.spend(0.6)
    except ValueError:
        refused = 1
    return spark.createDataFrame([(a.spent_epsilon, a.spent_delta, a.remaining()[0], refused)], "spent_epsilon double, spent_delta double, remaining_epsilon double, refused int")


@query("SELECT e AS epsilon, round(2.0 * sqrt(2 * ln(1.25 / 1e-5)) / e, 6) + 0.0 AS scale FROM (VALUES (0.1::DOUBLE), (1.0), (10.0)) t(e)")
def f2_noise_scale(spark, sf):
    return spark.createDataFrame([(e, round(privacy.noise_scale(2.0, e, 1e-5), 6)) for e in (0.1, 1.0, 10.0)], "epsilon double, scale double")


@query(f"WITH {BASE}, c AS (SELECT party, x * least(1, 5 / (sqrt(x * x + y * y) + 1e-10)) AS x, y * least(1, 5 / (sqrt(x * x + y * y) + 1e-10)) AS y FROM samples) SELECT party, round(avg(x), 6) + 0.0 AS m0, round(avg(y), 6) + 0.0 AS m1, round(max(sqrt(x * x + y * y)), 6) + 0.0 AS most FROM c GROUP BY party")
def f3_clip(spark, sf):
    c = privacy.clip(lineitem(spark, sf), 5.0)
    return c.groupBy("party").agg(r(F.avg(F.col("features")[0])).alias("m0"), r(F.avg(F.col("features")[1])).alias("m1"), r(F.max(privacy.norm())).alias("most"))


@query(f"WITH {BASE} SELECT round(quantile_cont(sqrt(x * x + y * y), 0.95), 6) + 0.0 AS bound FROM samples")
def f4_clip_bound(spark, sf):
    return numbers(spark, bound=privacy.clip_bound(lineitem(spark, sf)))


@query(f"WITH {BASE} SELECT CAST(party AS VARCHAR) AS party, n AS n_samples, round(9.0 / n * sqrt(2 * ln(1.25 / 5e-6)) / 0.5, 6) + 0.0 AS mean_noise_scale, round(2 * 81.0 / n * sqrt(2 * ln(1.25 / 5e-6)) / 0.5, 6) + 0.0 AS cov_noise_scale FROM stats")
def f5_private_fit(spark, sf):
    est = privacy.PrivatePCA(1, 7, epsilon=1.0, delta=1e-5, clip_bound=9.0).fit(lineitem(spark, sf))
    return est.noise_frame(spark).select("party", "n_samples", r("mean_noise_scale").alias("mean_noise_scale"), r("cov_noise_scale").alias("cov_noise_scale"))


def _noise_sql(seeds: list[int], parties: int = 3) -> str:
    """Standard draws of each trial and party, in the order in which they are made: two for the mean, four for the matrix."""
    rows = []
    for t, seed in enumerate(seeds):
        rng = np.random.RandomState(seed)
        for p in range(parties):
            z, g = rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
            values = map(float, (*z, g[0, 0], (g[0, 1] + g[1, 0]) / 2, g[1, 1]))
            rows.append(f"({t}, {p}, {', '.join(map(repr, values))})")
    return "z AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(trial, party, z0, z1, g00, g01, g11))"


def _noisy_sql(seeds: list[int], epsilons: list[float], bound: str) -> str:
    """CTEs to `pool`: the pooled noisy moments of each epsilon and trial, from rows clipped to a bound, half the budget on mean and matrix each."""
    values = ", ".join(f"({e!r})" for e in epsilons)
    return f"""{_noise_sql(seeds)}, eps AS (SELECT * FROM (VALUES {values}) t(epsilon)),
bound AS ({bound}),
clipped AS (SELECT party, x * least(1, b / (sqrt(x * x + y * y) + 1e-10)) AS x, y * least(1, b / (sqrt(x * x + y * y) + 1e-10)) AS y FROM samples, bound),
cs AS (SELECT party, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM clipped GROUP BY party),
scaled AS (SELECT cs.*, trial, CAST(epsilon AS DOUBLE) AS epsilon, z0, z1, g00, g01, g11, bound.b / n * sqrt(2 * ln(1.25 / 5e-6)) / (epsilon / 2) AS sm, 2 * bound.b * bound.b / n * sqrt(2 * ln(1.25 / 5e-6)) / (epsilon / 2) AS sc FROM cs JOIN z USING (party), eps, bound),
noisy AS (SELECT *, mx + sm * z0 AS nx, my + sm * z1 AS ny, a + sc * g00 AS na, b + sc * g01 AS nb, c + sc * g11 AS nc,
  sqrt(mx * mx + my * my) / (sm * sqrt(z0 * z0 + z1 * z1) + 1e-10) AS snr_mean, sqrt(a * a + 2 * b * b + c * c) / (sc * sqrt(g00 * g00 + 2 * g01 * g01 + g11 * g11) + 1e-10) AS snr_cov FROM scaled),
centre AS (SELECT epsilon, trial, sum(n) AS nn, sum(n * nx) / sum(n) AS px, sum(n * ny) / sum(n) AS py FROM noisy GROUP BY epsilon, trial),
pool AS (SELECT epsilon, trial, px, py, sum(n * (na + (nx - px) ** 2)) / nn AS a, sum(n * (nb + (nx - px) * (ny - py))) / nn AS b, sum(n * (nc + (ny - py) ** 2)) / nn AS c FROM noisy JOIN centre USING (epsilon, trial) GROUP BY epsilon, trial, px, py, nn),
psd AS (SELECT *, greatest(0, 1e-6 - low) * CAST(low < 0 AS INTEGER) AS lift FROM (SELECT *, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS low FROM pool)),
axis AS (SELECT *, (a + c) / 2 + lift + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, b / sqrt(b * b + (sqrt(((a - c) / 2) ** 2 + b * b) - (a - c) / 2) ** 2) AS u, (sqrt(((a - c) / 2) ** 2 + b * b) - (a - c) / 2) / sqrt(b * b + (sqrt(((a - c) / 2) ** 2 + b * b) - (a - c) / 2) ** 2) AS v FROM psd)"""


@query(f"WITH {BASE}, {_noisy_sql([7], [1.0], 'SELECT CAST(9 AS DOUBLE) AS b')} SELECT round(px, 6) + 0.0 AS m0, round(py, 6) + 0.0 AS m1, round(l1, 6) + 0.0 AS eigenvalue, round(l1 / (a + c + 2 * lift), 6) + 0.0 AS ratio, round(abs(u), 6) + 0.0 AS w0, round(abs(v), 6) + 0.0 AS w1 FROM axis")
def f6_private_model(spark, sf):
    """The released model itself: clipping, the seed's noise on every party, pooling."""
    m = privacy.PrivatePCA(1, 7, epsilon=1.0, delta=1e-5, clip_bound=9.0).fit(lineitem(spark, sf)).model
    return numbers(spark, m0=m.mean[0], m1=m.mean[1], eigenvalue=m.explained_variance[0], ratio=m.explained_variance_ratio[0], w0=abs(m.components[0, 0]), w1=abs(m.components[0, 1]))


@query("SELECT CAST(0 AS INTEGER) AS line_no, 'epsilon 1.0, delta 1e-05, clip bound 9.000000, parties 3' AS line UNION ALL SELECT CAST(1 + party AS INTEGER), '  ' || party || ': n ' || n FROM (" + f"WITH {BASE} SELECT party, n FROM stats)")
def f8_privacy_report(spark, sf):
    lines = privacy.PrivatePCA(1, 7, epsilon=1.0, delta=1e-5, clip_bound=9.0).fit(lineitem(spark, sf)).privacy_report().split("\n")
    return spark.createDataFrame([(k, x.split(", covariance")[0]) for k, x in enumerate(lines)], "line_no int, line string")


@query(f"""WITH {BASE}, {eig('truth', POOLED)}, {_noisy_sql([42, 43, 44], [1.0, 5.0, 10.0], 'SELECT quantile_cont(sqrt(x * x + y * y), 0.95) AS b FROM samples')},
far AS (SELECT epsilon, trial, degrees(asin(least(1, abs(axis.u * truth.v - axis.v * truth.u)))) AS angle FROM axis, truth),
angles AS (SELECT epsilon, avg(angle) AS m, stddev_pop(angle) AS s FROM far GROUP BY epsilon), snr AS (SELECT epsilon, avg(snr_mean) AS sm, avg(snr_cov) AS sc FROM noisy GROUP BY epsilon)
SELECT epsilon, round(m, 4) + 0.0 AS mean_angle, round(s, 4) + 0.0 AS std_angle, round(sm, 4) + 0.0 AS snr_mean, round(sc, 4) + 0.0 AS snr_cov FROM angles JOIN snr USING (epsilon)""")
def f9_privacy_tradeoff(spark, sf):
    out = privacy.privacy_tradeoff(spark, lineitem(spark, sf), 1, [1.0, 5.0, 10.0], trials=3)
    return out.select("epsilon", *(r(c, 4).alias(c) for c in ("mean_angle", "std_angle", "snr_mean", "snr_cov")))


@query()
def i15_sample_sizes(spark, sf):
    return privacy.sample_size_sweep(spark, embeddings(spark, sf), 4, [50, 100, 200], 5.0, trials=2)


SIZES = [("none", {}), ("low_rank", {"rank": 100}), ("sketch", {"sketch": 200}), ("quantize", {"bits": 16}), ("quantize", {"bits": 8}), ("top_k", {"k": 10_000}), ("combined", {"rank": 100, "bits": 16})]


@query("""SELECT method, bits AS bits_per_value, CAST(size AS BIGINT) AS compressed_size, CAST(3072 * 3072 + 3073 AS BIGINT) AS original_size, round((3072 * 3072 + 3073) * 64 / (size * bits + 64 * 3072 + 64), 6) + 0.0 AS compression_ratio
FROM (VALUES ('none', 64, 3072 * 3072), ('low_rank', 64, 3072 * 100 + 101), ('sketch', 64, 200 * 200), ('quantize', 16, 3072 * 3072), ('quantize', 8, 3072 * 3072), ('top_k', 64, 30000 + 3072), ('combined', 16, 3072 * 100 + 101)) t(method, bits, size)""")
def f18_compression_stats(spark, sf):
    rows = []
    for m, p in SIZES:
        s = compression.compression_stats(m, 3072, **p)
        rows.append((m, s["bits_per_value"], s["compressed_size"], s["original_size"], round(s["compression_ratio"], 6)))
    return spark.createDataFrame(rows, "method string, bits_per_value int, compressed_size long, original_size long, compression_ratio double")


@query(f"WITH {BASE}, {LOCAL} SELECT party, round(e1 * p * p + (a + c - e1) - (a + c - e1), 6) + 0.0 AS c00, round(e1 * p * q, 6) + 0.0 AS c01, round(e1 * q * q + (a + c - e1), 6) + 0.0 AS c11 FROM lu")
def f12_low_rank(spark, sf):
    s = compression.roundtrip(party_stats(lineitem(spark, sf)), compression.LowRank(1))
    cell = lambda k: r(F.col("m2")[k] / F.col("n"))
    return s.select("party", cell(0).alias("c00"), cell(1).alias("c01"), cell(2).alias("c11"))


@query(f"WITH {BASE}, {LOCAL} SELECT party, round(e1 * p * p + (a + c - e1) * (1 - p * p), 6) + 0.0 AS c00, round(e1 * p * q - (a + c - e1) * p * q, 6) + 0.0 AS c01, round(e1 * q * q + (a + c - e1) * (1 - q * q), 6) + 0.0 AS c11 FROM lu")
def f12_low_rank_subspace(spark, sf):
    s = compression.roundtrip(party_stats(lineitem(spark, sf)), compression.LowRank(1, "subspace"))
    cell = lambda k: r(F.col("m2")[k] / F.col("n"))
    return s.select("party", cell(0).alias("c00"), cell(1).alias("c01"), cell(2).alias("c11"))


def _sketch_sql() -> str:
    m = compression.Sketch(3, 1).matrix(2)
    (p, q), (_, t) = (m.T @ m).tolist()
    return f"""WITH {BASE}, l AS (SELECT party, {p!r} * a + {q!r} * b AS t00, {p!r} * b + {q!r} * c AS t01, {q!r} * a + {t!r} * b AS t10, {q!r} * b + {t!r} * c AS t11 FROM stats)
SELECT party, round(t00 * {p!r} + t01 * {q!r}, 6) + 0.0 AS c00, round(t00 * {q!r} + t01 * {t!r}, 6) + 0.0 AS c01, round(t10 * {q!r} + t11 * {t!r}, 6) + 0.0 AS c11 FROM l"""


@query(_sketch_sql())
def f13_sketch(spark, sf):
    """R'(R C R')R for each party, with the R of the seed."""
    return _restored(party_stats(lineitem(spark, sf)), compression.Sketch(3, 1))


def _restored(stats: DataFrame, made) -> DataFrame:
    cell = lambda k: r(F.col("m2")[k] / F.col("n"))
    return compression.roundtrip(stats, made).select("party", cell(0).alias("c00"), cell(1).alias("c01"), cell(2).alias("c11"))


@query(f"WITH {BASE}, {LOCAL} SELECT party, round(e1 * p * p, 6) + 0.0 AS c00, round(e1 * p * q, 6) + 0.0 AS c01, round(e1 * q * q + (a + c - e1), 6) + 0.0 AS c11 FROM lu")
def f16_combined(spark, sf):
    """Of two features an axis has two values, the least and the greatest, which quantisation keeps: what is left is the low rank."""
    return _restored(party_stats(lineitem(spark, sf)), compression.Combined(compression.LowRank(1), compression.Quantize(16)))


CELLS = f"WITH {BASE}, cells AS (SELECT party, 0 AS i, 0 AS j, a AS value FROM stats UNION ALL SELECT party, 0, 1, b FROM stats UNION ALL SELECT party, 1, 1, c FROM stats)"


@query(CELLS + ", w AS (SELECT *, min(value) OVER (PARTITION BY party) AS lo, max(value) OVER (PARTITION BY party) AS hi FROM cells), q AS (SELECT *, floor((value - lo) / (hi - lo) * 255) AS code FROM w) SELECT party, i, j, CAST(code AS INTEGER) AS code, round(code / 255 * (hi - lo) + lo, 6) + 0.0 AS restored FROM q")
def f14_quantize(spark, sf):
    return compression.quantized_cells(covariances(party_stats(lineitem(spark, sf))), 8).select("party", "i", "j", "code", r("restored").alias("restored"))


@query("WITH " + EMBED + """, s AS (SELECT party, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), c AS (SELECT a.party, a.i, b.i AS j, covar_pop(a.x, b.x) AS value FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.party, a.i, b.i),
k AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY abs(value) DESC, i, j) AS r FROM c)
SELECT party, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 6) + 0.0 AS value FROM k WHERE r <= 100 OR i = j""")
def f15_top_k(spark, sf):
    return compression.largest_cells(covariances(party_stats(embeddings(spark, sf))), 100).select("party", "i", "j", r("value").alias("value"))


@query(first_axis(POOLED))
def f17_compressed_fit(spark, sf):
    """Through the plain codec, the compressed path is P-COV."""
    return components(spark, compression.CompressedPCA(2, method="none").fit(lineitem(spark, sf)).model).where("idx = 0").withColumn("ratio_kept", F.lit(1.0))


def _compressed_sql() -> str:
    """Angles of the pooled model after each codec on every party's matrix, in closed form."""
    restored = {
        "none": "SELECT party, a, b, c FROM stats",
        "low_rank": "SELECT party, e1 * p * p AS a, e1 * p * q AS b, e1 * q * q + (a + c - e1) AS c FROM lu",
        "quantize": "SELECT party, trunc((a - lo) / (hi - lo) * 255) / 255 * (hi - lo) + lo AS a, trunc((b - lo) / (hi - lo) * 255) / 255 * (hi - lo) + lo AS b, trunc((c - lo) / (hi - lo) * 255) / 255 * (hi - lo) + lo AS c FROM (SELECT *, least(a, b, c) AS lo, greatest(a, b, c) AS hi FROM stats)",
        "top_k": "SELECT party, a, CASE WHEN abs(b) > least(abs(a), abs(c)) THEN b ELSE 0 END AS b, c FROM stats",
    }
    ctes, rows = [], []
    for (name, params, size, bits), sql in zip((("none", "", 4, 64), ("low_rank", "rank=1", 4, 64), ("quantize", "bits=8", 4, 8), ("top_k", "top_k=2", 8, 64)), restored.values()):
        pooled = f"SELECT gx AS mx, gy AS my, sum(s.n * (r.a + (mx - gx) ** 2)) / nn AS a, sum(s.n * (r.b + (mx - gx) * (my - gy))) / nn AS b, sum(s.n * (r.c + (my - gy) ** 2)) / nn AS c FROM ({sql}) r JOIN stats s USING (party), tot GROUP BY gx, gy, nn"
        ctes.append(eig(name, pooled))
        rows.append(f"SELECT '{name}' AS method, '{params}' AS params, round(degrees(asin(least(1, abs(truth.u * o.v - truth.v * o.u)))), 4) + 0.0 AS mean_angle, round(7 * 64 / ({size} * {bits} + 192), 6) + 0.0 AS compression_ratio, round(({size} * {bits} + 192) / 8192, 6) + 0.0 AS kilobytes FROM truth, {name} o")
    return f"WITH {BASE}, {LOCAL}, {eig('truth', POOLED)}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query(_compressed_sql())
def f20_evaluate_compression(spark, sf):
    s = lineitem(spark, sf)
    configs = [("none", {}), ("low_rank", {"rank": 1}), ("quantize", {"bits": 8}), ("top_k", {"top_k": 2})]
    out = compression.evaluate_compression(spark, s, party_stats(s), 1, configs).orderBy(F.desc("compression_ratio"))
    return out.select("method", "params", r("mean_angle", 4).alias("mean_angle"), r("compression_ratio").alias("compression_ratio"), r("kilobytes").alias("kilobytes"))


@query("SELECT CAST(k AS INTEGER) AS line_no, line FROM (VALUES (0, 'method quantize, 3 parties, 2 features'), (1, '  original_size: 7'), (2, '  compressed_size: 4'), (3, '  compression_ratio: 2.0000'), (4, '  bits_per_value: 8'), (5, '  total_bits: 224')) t(k, line)")
def f19_compression_report(spark, sf):
    lines = compression.CompressedPCA(1, method="quantize", bits=8).fit(lineitem(spark, sf)).compression_report().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


@query("SELECT 'full' AS method, round(8.0 * 3072 * 3072 / 1e6, 6) AS megabytes, 0.0 AS savings UNION ALL SELECT 'low_rank_' || k, round(8.0 * (3072 * k + k + 1) / 1e6, 6), round(100 * (1 - (3072 * k + k + 1) / (3072.0 * 3072)), 6) FROM (VALUES (100), (200)) t(k) UNION ALL SELECT 'quantize_' || b, round(3072 * 3072 * b / 8 / 1e6, 6), round(100 * (1 - b / 64.0), 6) FROM (VALUES (8), (16)) t(b)")
def i16_bandwidth(spark, sf):
    return spark.createDataFrame([(m, round(a, 6), round(b, 6)) for m, a, b in experiment.bandwidth()], "method string, megabytes double, savings double")


# H: metrics


def _two(spark, sf):
    """Samples, their pooled moments, and the models of P-COV and AP-COV."""
    s = lineitem(spark, sf)
    stats = party_stats(s).persist(StorageLevel.MEMORY_AND_DISK)
    out = s, combine.pooled_moments(stats), combine.pcov(stats, 1), combine.apcov(stats, 1)
    stats.unpersist()
    return out


@query(ANGLE + " SELECT round(asin(sin), 6) + 0.0 AS angle, round(degrees(asin(sin)), 6) + 0.0 AS degrees, round(cos, 6) + 0.0 AS alignment, round(asin(sin), 6) + 0.0 AS grassmann, round(sin, 6) + 0.0 AS chordal, round(sin, 6) + 0.0 AS projection, round(cos, 6) + 0.0 AS correlation, round(cos * cos, 6) + 0.0 AS overlap FROM d")
def h1_subspace_metrics(spark, sf):
    _, _, p, q = _two(spark, sf)
    u, v = p.components, q.components
    angle = metrics.principal_angles(u, v)[0]
    return numbers(spark, angle=angle, degrees=np.degrees(angle), alignment=metrics.alignment_score(u, v), **{m: metrics.subspace_distance(u, v, m) for m in ("grassmann", "chordal", "projection")}, correlation=metrics.component_correlation(u, v)[0], overlap=metrics.subspace_overlap(u, v))


RESIDUAL = SCORES + ", e AS (SELECT row_id, x, y, x - mx - z * u AS dx, y - my - z * v AS dy FROM z)"


@query(RESIDUAL + " SELECT round(sum(dx * dx + dy * dy) / (2 * count(*)), 6) + 0.0 AS mse, round(sqrt(sum(dx * dx + dy * dy) / (2 * count(*))), 6) + 0.0 AS rmse, round(sum(abs(dx) + abs(dy)) / (2 * count(*)), 6) + 0.0 AS mae, round(sqrt(sum(dx * dx + dy * dy)) / (sqrt(sum(x * x + y * y)) + 1e-10), 6) + 0.0 AS relative_error FROM e")
def h7_reconstruction(spark, sf):
    s, _, p, _ = _two(spark, sf)
    return metrics.reconstruction_errors(s, p).select(*(r(c).alias(c) for c in ("mse", "rmse", "mae", "relative_error")))


@query(RESIDUAL + " SELECT row_id, round((dx * dx + dy * dy) / 2, 4) + 0.0 AS error FROM e")
def h9_per_sample_error(spark, sf):
    s, _, p, _ = _two(spark, sf)
    return metrics.per_sample_error(s, p).select("row_id", r("error", 4).alias("error"))


@query(f"WITH {BASE}, {eig('p', POOLED)}, {eig('q', AVERAGED)}, e AS (SELECT avg((((x - p.mx) * p.v - (y - p.my) * p.u) ** 2) / 2) AS a, avg((((x - q.mx) * q.v - (y - q.my) * q.u) ** 2) / 2) AS b FROM samples, p, q) SELECT round(b, 6) + 0.0 AS model_mse, round(a, 6) + 0.0 AS baseline_mse, round(b / (a + 1e-10), 6) + 0.0 AS ratio FROM e")
def h10_error_ratio(spark, sf):
    s, _, p, q = _two(spark, sf)
    return metrics.reconstruction_error_ratio(s, q, p).select(*(r(c).alias(c) for c in ("model_mse", "baseline_mse", "ratio")))


@query(SCORES + " SELECT round(l2 / 2, 6) + 0.0 AS mse, round(l1 / (a + c + 1e-10), 6) + 0.0 AS retention, round(l1 / (a + c + 1e-10), 6) + 0.0 AS ratio FROM p")
def h13_variance_from_statistics(spark, sf):
    """Reconstruction error, retention and ratio from the statistics table, without a scan of rows."""
    _, m, p, _ = _two(spark, sf)
    return numbers(spark, mse=metrics.mse_from_moments(m, p), retention=metrics.variance_retention(m, p), ratio=metrics.explained_variance_ratio(p, m, recompute=True)[0])


@query(f"WITH {BASE}, {eig('p', POOLED)} SELECT CAST(0 AS INTEGER) AS idx, round(l1 / (a + c), 6) + 0.0 AS cumulative FROM p UNION ALL SELECT 1, 1.0")
def h12_cumulative_variance(spark, sf):
    m = estimator("P-COV", 2).fit(lineitem(spark, sf)).model
    return metrics.cumulative_variance(m.frame(spark)).select("idx", r("cumulative").alias("cumulative"))


@query(f"WITH {BASE}, {eig('p', POOLED)}, {eig('q', AVERAGED)} SELECT round(p.l1 / (p.a + p.c), 6) + 0.0 AS total_a, round(q.l1 / (q.a + q.c), 6) + 0.0 AS total_b, round(abs(p.l1 / (p.a + p.c) - q.l1 / (q.a + q.c)), 6) + 0.0 AS max_abs_difference FROM p, q")
def h14_compare_variance(spark, sf):
    _, _, p, q = _two(spark, sf)
    c = metrics.compare_variance(p, q)
    return numbers(spark, total_a=c["total_a"], total_b=c["total_b"], max_abs_difference=c["max_abs_difference"])


KNN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT t.vec_id, t.label AS truth, s.label, row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.v, s.v), s.vec_id) AS rk FROM e t, e s WHERE t.vec_id % 5 = 0 AND s.vec_id % 5 <> 0),
votes AS (SELECT vec_id, truth, label, count(*) AS n FROM d WHERE rk <= 5 GROUP BY ALL), p AS (SELECT vec_id, truth, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM votes) WHERE k = 1)"""


@query(KNN + " SELECT vec_id AS row_id, truth AS label, predicted FROM p")
def h15_knn(spark, sf):
    s = embeddings(spark, sf)
    return downstream.predict(s.where("row_id % 5 != 0"), s.where("row_id % 5 = 0"), "knn")


@query(KNN + """, t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (WHERE truth = predicted) AS hit FROM p GROUP BY truth), s AS (SELECT predicted AS label, count(*) AS said FROM p GROUP BY predicted),
c AS (SELECT support, hit, coalesce(hit / said, 0) AS pr, hit / support AS re FROM t LEFT JOIN s USING (label)), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM c)
SELECT round(sum(hit) / sum(support), 6) + 0.0 AS accuracy, round(sum(pr * support) / sum(support), 6) + 0.0 AS "precision", round(sum(re * support) / sum(support), 6) + 0.0 AS recall, round(sum(f * support) / sum(support), 6) + 0.0 AS f1 FROM f""")
def h15_knn_metrics(spark, sf):
    s = embeddings(spark, sf)
    m = downstream.evaluate_classification(s.where("row_id % 5 != 0"), s.where("row_id % 5 = 0"))
    return m.select(*(r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query()
def h15_logistic(spark, sf):
    s = embeddings(spark, sf)
    return downstream.evaluate_classification(s.where("row_id % 5 != 0"), s.where("row_id % 5 = 0"), "logistic")


@query()
def h15_svm(spark, sf):
    s = embeddings(spark, sf)
    return downstream.evaluate_classification(s.where("row_id % 5 != 0"), s.where("row_id % 5 = 0"), "svm")


@query("SELECT 0.0 AS accuracy_difference, 0.0 AS f1_difference")
def h16_compare_classification(spark, sf):
    """All 64 components rotate the data: nearest neighbours stay."""
    s = embeddings(spark, sf)
    z = estimator("P-COV", 64).fit(s).transform(s).select("row_id", "label", F.col("scores").alias("features"))
    part = lambda f: (f.where("row_id % 5 != 0"), f.where("row_id % 5 = 0"))
    return downstream.compare_classification(*part(s), *part(z)).select(r("accuracy_difference").alias("accuracy_difference"), r("f1_difference").alias("f1_difference"))


# H, I: frames to plot, experiments


@query(f"WITH {BASE}, {eig('p', POOLED)}, {eig('q', AVERAGED)} SELECT 'P-COV' AS method, CAST(0 AS INTEGER) AS idx, round(l1 / (a + c), 6) + 0.0 AS cumulative FROM p UNION ALL SELECT 'AP-COV', 0, round(l1 / (a + c), 6) + 0.0 FROM q")
def h17_variance_curves(spark, sf):
    _, _, p, q = _two(spark, sf)
    return experiment.variance_curves(spark, {"P-COV": p, "AP-COV": q}).select("method", "idx", r("cumulative").alias("cumulative"))


@query(ANGLE + " SELECT 'AP-COV' AS method, CAST(0 AS INTEGER) AS idx, round(degrees(asin(sin)), 6) + 0.0 AS angle FROM d")
def h18_angle_bars(spark, sf):
    _, _, p, q = _two(spark, sf)
    return experiment.angle_bars(spark, p, {"AP-COV": q}).select("method", "idx", r("angle").alias("angle"))


@query(BOTH_AXES.split("SELECT CAST(idx AS INTEGER)")[0] + ", a AS (SELECT max(CASE WHEN idx = 0 THEN w0 END) AS a0, max(CASE WHEN idx = 0 THEN w1 END) AS a1, max(CASE WHEN idx = 1 THEN w0 END) AS b0, max(CASE WHEN idx = 1 THEN w1 END) AS b1 FROM q) SELECT row_id, label, 'P-COV' AS method, round((x - mx) * a0 + (y - my) * a1, 4) + 0.0 AS pc1, round((x - mx) * b0 + (y - my) * b1, 4) + 0.0 AS pc2 FROM samples, p, a")
def h24_projections(spark, sf):
    s = lineitem(spark, sf)
    m = estimator("P-COV", 2).fit(s).model
    return experiment.projections(s, {"P-COV": m}).select("row_id", "label", "method", r("pc1", 4).alias("pc1"), r("pc2", 4).alias("pc2"))


RESULTS = [("iid", "P-COV", 0.01), ("iid", "AP-COV", 0.03), ("iid", "QR-PCA", 1.06), ("shard", "P-COV", 0.01), ("shard", "AP-COV", 1.04), ("shard", "QR-PCA", 1.8)]
RESULTS_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in RESULTS) + ") v(partition, method, mean_angle))"


def _results(spark):
    return spark.createDataFrame(RESULTS, "partition string, method string, mean_angle double")


@query(f"WITH {RESULTS_SQL} SELECT partition, max(mean_angle) FILTER (WHERE method = 'AP-COV') AS \"AP-COV\", max(mean_angle) FILTER (WHERE method = 'P-COV') AS \"P-COV\", max(mean_angle) FILTER (WHERE method = 'QR-PCA') AS \"QR-PCA\" FROM t GROUP BY partition")
def h20_method_pivot(spark, sf):
    return experiment.method_pivot(_results(spark), "partition", "mean_angle", ["AP-COV", "P-COV", "QR-PCA"])


@query(f"WITH {RESULTS_SQL}, b AS (SELECT partition, min(mean_angle) AS value, arg_min(method, mean_angle) AS best FROM t GROUP BY partition) SELECT partition, method, mean_angle, best, value, abs(mean_angle - value) < 0.1 AS matches FROM t JOIN b USING (partition)")
def i12_best_method(spark, sf):
    return experiment.best_method(_results(spark), ["partition"])


@query("SELECT p AS partition, CAST(a AS DOUBLE) AS parameter, CAST(k AS INTEGER) AS num_clients, CAST(c AS INTEGER) AS n_components FROM (VALUES ('iid', 0), ('dirichlet', 0.5), ('shard', 0)) t(p, a), (VALUES (5), (10), (50)) u(k), (VALUES (10), (50)) v(c) WHERE NOT (k = 50 AND c = 50)")
def i5_grid(spark, sf):
    return experiment.grid(spark, [("iid", {}), ("dirichlet", {"alpha": 0.5}), ("shard", {})], [5, 10, 50], [10, 50])


def _card_sql(party: str, more: str = "") -> str:
    """Scores of P-COV and AP-COV with one component, over parties that an SQL expression names."""
    base = BASE.replace("SELECT party, count(*) AS n", f"SELECT {party} AS party, count(*) AS n").replace("FROM samples GROUP BY party)", "FROM samples GROUP BY 1)")
    part = lambda m, rounds, angle, cos, axis: f"SELECT {more} '{m}' AS method, CAST(1 AS INTEGER) AS n_components, round({angle}, 4) + 0.0 AS mean_angle, round({angle}, 4) + 0.0 AS max_angle, round({cos}, 6) + 0.0 AS alignment, round((p.a + p.c - ({axis}.u * {axis}.u * p.a + 2 * {axis}.u * {axis}.v * p.b + {axis}.v * {axis}.v * p.c)) / 2, 6) + 0.0 AS reconstruction_mse, round({axis}.l1 / ({axis}.a + {axis}.c), 6) + 0.0 AS explained, CAST({rounds} AS INTEGER) AS rounds, 48 * kk AS total_bytes FROM p, q, tot"
    return f"SELECT * FROM (WITH {base}, {eig('p', POOLED)}, {eig('q', AVERAGED)} {part('P-COV', 2, '0.0', '1.0', 'p')} UNION ALL {part('AP-COV', 1, 'degrees(asin(abs(p.u * q.v - p.v * q.u)))', 'abs(p.u * q.u + p.v * q.v)', 'q')})"


def _card(card: DataFrame, *more: str) -> DataFrame:
    return card.select(*more, "method", "n_components", *(r(c, n).alias(c) for c, n in (("mean_angle", 4), ("max_angle", 4), ("alignment", 6), ("reconstruction_mse", 6), ("explained", 6))), "rounds", "total_bytes")


@query(_card_sql("party"))
def i3_scorecard(spark, sf):
    return _card(experiment.scorecard(spark, lineitem(spark, sf), None, 1, ["P-COV", "AP-COV"]))


@query()
def i3_scorecard_embeddings(spark, sf):
    """All methods, with nearest-neighbour accuracy."""
    s = embeddings(spark, sf)
    return experiment.scorecard(spark, s.where("row_id % 5 != 0"), s.where("row_id % 5 = 0"), 8)


def _sweep_sql() -> str:
    u = U.format(seed=42).replace("vec_id", "row_id")
    cells = []
    for k in (2, 4):
        cuts = ", ".join(repr(float(x)) for x in np.cumsum(DataPartitioner(k).quantity_shares(1.5))[:-1])
        for name, parameter, party in (("iid", 0.0, f"floor({u} * {k})"), ("quantity_skew", 1.5, f"len(list_filter([{cuts}], lambda s: s <= {u}))")):
            cells.append(_card_sql(party, f"'{name}' AS partition, CAST({parameter} AS DOUBLE) AS parameter, CAST({k} AS INTEGER) AS num_clients,"))
    return " UNION ALL ".join(cells)


@query(_sweep_sql())
def i6_sweep(spark, sf):
    out = experiment.sweep(spark, lineitem(spark, sf), [("iid", {}), ("quantity_skew", {"power": 1.5})], [2, 4], [1], ["P-COV", "AP-COV"])
    return _card(out, "partition", "parameter", "num_clients")


SWEPT = [(p, a, k, m, round(0.01 * (1 + a) * k + 0.2 * (m == "AP-COV"), 4)) for p, a in (("dirichlet", 0.1), ("dirichlet", 1.0), ("iid", 0.0)) for k in (5, 20) for m in ("AP-COV", "P-COV")]
SWEPT_SQL = "t AS (SELECT partition, CAST(parameter AS DOUBLE) AS parameter, CAST(num_clients AS INTEGER) AS num_clients, method, CAST(mean_angle AS DOUBLE) AS mean_angle FROM (VALUES " + ", ".join(map(str, SWEPT)) + ") v(partition, parameter, num_clients, method, mean_angle))"


def _swept(spark):
    return spark.createDataFrame(SWEPT, "partition string, parameter double, num_clients int, method string, mean_angle double")


@query(f"WITH {SWEPT_SQL} SELECT method, round(avg(mean_angle), 6) AS value FROM t GROUP BY method")
def h19_metric_bars(spark, sf):
    return experiment.metric_bars(_swept(spark), "mean_angle").select("method", r("value").alias("value"))


@query(f"WITH {SWEPT_SQL} SELECT parameter, method, round(avg(mean_angle), 6) AS value FROM t WHERE partition = 'dirichlet' GROUP BY ALL")
def h21_robustness(spark, sf):
    return experiment.robustness(_swept(spark)).select("parameter", "method", r("value").alias("value"))


@query(f"WITH {SWEPT_SQL} SELECT num_clients, method, round(avg(mean_angle), 6) AS value FROM t GROUP BY ALL")
def h22_scalability(spark, sf):
    return experiment.scalability(_swept(spark)).select("num_clients", "method", r("value").alias("value"))


@query(f"WITH {SWEPT_SQL} SELECT partition, num_clients, method, mean_angle FROM t WHERE partition = 'iid'")
def i7_summary(spark, sf):
    return experiment.summary(_swept(spark), "iid").select("partition", "num_clients", "method", "mean_angle")


@query(SCORES + " SELECT row_id, label, round(z, 4) + 0.0 AS x FROM z")
def i17_cached_projection(spark, sf):
    """Scores held once, read for points."""
    s = lineitem(spark, sf)
    held = experiment.Projection(estimator("P-COV", 1).fit(s).model, s)
    return held.points(0, 0).select("row_id", "label", r("x", 4).alias("x"))


@query(f"WITH {BASE}, {eig('p', POOLED)} SELECT row_id, round((x - mx) * u + (y - my) * v, 4) + 0.0 AS score, round(sqrt(x * x + y * y), 4) + 0.0 AS norm FROM samples, p")
def j_sql_functions(spark, sf):
    """The model through SQL: registered functions on a view."""
    s = lineitem(spark, sf)
    m = estimator("P-COV", 1).fit(s).model
    sql_functions.register(spark)
    s.createOrReplaceTempView("eigenweave_samples")
    array = lambda xs: "array(" + ", ".join(f"{float(x)!r}D" for x in xs) + ")"
    return spark.sql(f"SELECT row_id, round(pca_project(features, {array(m.mean)}, array({array(m.components[0])}))[0], 4) + 0.0 AS score, round(vec_norm(features), 4) + 0.0 AS norm FROM eigenweave_samples")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled-covariance components of the embeddings, split over five parties."""
    return estimator("P-COV", 8).fit(embeddings(spark, sf)).model.frame(spark)

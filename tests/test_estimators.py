import numpy as np
import pytest

from eigenweave.operators import combine, metrics
from eigenweave.operators.estimators import METHODS, estimator
from eigenweave.operators.model import NotFitted, PCAModel
from eigenweave.operators.stats import Moments, party_stats
from eigenweave.sources import samples as src
from helpers import frame


@pytest.fixture(scope="module")
def parties():
    rng = np.random.RandomState(42)
    return [rng.randn(100, 50) for _ in range(5)]


@pytest.fixture(scope="module")
def data(spark, parties):
    return frame(spark, parties).cache()


def truth(parties, k):
    x = np.concatenate(parties)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    return vectors[:, ::-1].T[:k], values[::-1][:k], x


def test_components_are_orthonormal_rows(data):
    for name in METHODS:
        m = estimator(name, 5, 42).fit(data).model
        assert m.components.shape == (5, 50) and m.mean.shape == (50,)
        assert np.allclose(m.components @ m.components.T, np.eye(5), atol=1e-10)
        assert (np.diff(m.explained_variance) <= 1e-12).all()


@pytest.mark.parametrize("name", ["Centralized", "P-COV"])
def test_exact_methods_equal_pooled(data, parties, name):
    rows, values, x = truth(parties, 5)
    m = estimator(name, 5).fit(data).model
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.explained_variance, values)
    assert metrics.principal_angles(rows, m.components).max() < 1e-8


def test_single_party_equals_pooled(spark, parties):
    f = frame(spark, parties[:1])
    rows, _, _ = truth(parties[:1], 5)
    assert metrics.principal_angles(rows, estimator("P-COV", 5).fit(f).model.components).max() < 1e-8


def test_subspace_iteration(data, parties):
    rows, values, _ = truth(parties, 5)
    est = estimator("SUB-IT", 5, 42, max_iter=500, tol=1e-8).fit(data)
    assert metrics.alignment_score(rows, est.model.components) > 0.99
    cost = est.communication_cost()
    assert cost["total_bytes"] == (cost["iterations"] + 1) * 5 * 8 * 50 * 5


def test_subspace_iteration_by_jobs_equals_matrix_form(data):
    from eigenweave.operators.iterate import subspace_iteration

    a = subspace_iteration(data, 3, 6, 1e-12, 1)
    b = subspace_iteration(data, 3, 6, 1e-12, 1, matrix_dims=0)
    assert np.allclose(a.components, b.components) and np.allclose(a.info["history"], b.info["history"])


def test_stacks(data, parties):
    rows, values, _ = truth(parties, 5)
    assert metrics.alignment_score(rows, estimator("AP-STACK", 5, local_components=20).fit(data).model.components) > 0.8
    exact = estimator("QR-PCA", 5, local_components=50, weighting="exact").fit(data).model
    assert np.allclose(exact.explained_variance, values) and metrics.alignment_score(rows, exact.components) > 0.9999


def test_few_rows_use_singular_values(spark, rng):
    x = rng.randn(4, 12)
    m = estimator("AP-STACK", 2).fit(frame(spark, [x])).model
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(m.explained_variance, s[:2] ** 2)


def test_averaged_under_mean_shift(spark, rng):
    parties = [rng.randn(100, 50) + 2 * i for i in range(5)]
    f = frame(spark, parties)
    rows, _, _ = truth(parties, 5)
    m = estimator("AP-COV", 5).fit(f).model
    assert metrics.alignment_score(rows, m.components) > 0.5
    assert np.allclose(m.total_variance, np.trace(np.mean([np.cov(p.T, bias=True) for p in parties], axis=0)))


def test_transform_and_inverse(data, parties):
    est = estimator("P-COV", 50).fit(data)
    out = est.inverse_transform(est.transform(data)).orderBy("row_id").toPandas()
    assert np.allclose(np.stack(out.restored), np.concatenate(parties))
    small = estimator("P-COV", 2).fit(data)
    z = np.stack(small.transform(data).orderBy("row_id").toPandas().scores)
    assert np.allclose(z, small.model.project(np.concatenate(parties)))


def test_sql_and_arrow_projection_agree(spark, rng):
    x = rng.randn(30, 3)
    m = PCAModel.build(np.linalg.qr(rng.randn(3, 2))[0].T, rng.randn(3), np.ones(2), 3.0)
    f = frame(spark, [x])
    a = np.stack(f.withColumn("z", m.projection(f.features)).orderBy("row_id").toPandas().z)
    assert np.allclose(a, m.project(x))
    b = np.stack(m._map(f, "features", "z", 3, m.project).orderBy("row_id").toPandas().z)
    assert np.allclose(a, b)


def test_unfitted_and_bad_parameters(spark, data):
    with pytest.raises(NotFitted):
        estimator("P-COV", 2).transform(data)
    with pytest.raises(ValueError):
        estimator("P-COV", 0)
    with pytest.raises(ValueError):
        estimator("nothing", 2)
    with pytest.raises(ValueError):
        estimator("P-COV", 2).fit(data.where("false"))


def test_statistics_small_and_large_width_agree(spark, rng):
    x = [rng.randn(40, 8) + 100, rng.randn(1, 8)]
    from eigenweave.operators import stats

    f = frame(spark, x).repartition(3)
    sql = {r["party"]: r for r in stats._sql_stats(f, 8).collect()}
    stats_dims, stats.SQL_DIMS = stats.SQL_DIMS, 0
    try:
        arrow = {r["party"]: r for r in party_stats(f).collect()}
    finally:
        stats.SQL_DIMS = stats_dims
    for p in (0, 1):
        assert sql[p]["n"] == arrow[p]["n"] == len(x[p])
        assert np.allclose(sql[p]["mean"], arrow[p]["mean"]) and np.allclose(sql[p]["m2"], arrow[p]["m2"], atol=1e-9)


def test_moments_merge_and_unmerge(rng):
    a, b = rng.randn(20, 4) + 5, rng.randn(7, 4)
    both = Moments.of(a).merge(Moments.of(b))
    assert np.allclose(both.cov, np.cov(np.concatenate((a, b)).T, bias=True))
    back = both.without(Moments.of(b))
    assert back.n == 20 and np.allclose(back.mean, a.mean(0)) and np.allclose(back.m2, Moments.of(a).m2)


def test_lengths_must_agree(spark):
    f = spark.createDataFrame([(0, 1, [1.0, 2.0], 0), (0, 2, [1.0], 0)], "party int, row_id long, features array<double>, label int")
    with pytest.raises(ValueError):
        party_stats(f)


def test_samples_drop_null_rows_and_keep_null_party(spark):
    df = spark.createDataFrame([(1, None, [1.0, 2.0]), (2, "a", None), (3, "a", [1.0, None]), (4, "a", [0.0, 1.0])], "id long, who string, v array<double>")
    s = src.samples(df, "v", "who", "id")
    assert s.count() == 2
    assert {r["party"]: r["n"] for r in party_stats(s).collect()} == {None: 1, "a": 1}


def test_save_and_load(spark, data, tmp_path):
    m = estimator("SUB-IT", 3, 1).fit(data).model
    m.save(spark, f"file://{tmp_path}/m")
    back = PCAModel.load(spark, f"file://{tmp_path}/m")
    assert np.allclose(back.components, m.components) and np.allclose(back.mean, m.mean) and back.info == m.info


def test_qr_reference_weighting_is_low_by_party_count(data, parties):
    m = combine.qr(party_stats(data), 5, 50)
    _, values, _ = truth(parties, 5)
    assert np.allclose(m.explained_variance * 5, values)

import numpy as np
import pytest

from eigenweave.operators import adaptive, compression, metrics, privacy
from eigenweave.operators.estimators import estimator
from eigenweave.operators.linalg import canonical, nearest_psd, pack, unpack
from eigenweave.operators.stats import Moments, party_stats
from eigenweave.streaming.incremental import StreamingPCA
from helpers import frame


def test_angle_identities():
    e = np.eye(10)
    assert np.allclose(metrics.principal_angles(e[:5], e[:5]), 0)
    assert np.allclose(metrics.principal_angles(e[:2], e[2:4]), np.pi / 2)
    assert metrics.subspace_distance(e[:2], e[2:4], "projection") == pytest.approx(1)
    with pytest.raises(ValueError):
        metrics.subspace_distance(e[:2], e[:2], "other")


def test_alignment_range(rng):
    u, v = np.linalg.qr(rng.randn(10, 3))[0].T, np.linalg.qr(rng.randn(10, 3))[0].T
    assert 0 <= metrics.alignment_score(u, v) <= 1
    tiny = u.copy()
    tiny[0] += 1e-9 * v[0]
    assert metrics.principal_angles(u, tiny).max() < 2e-9


def test_canonical_and_packing(rng):
    v = canonical(-np.abs(rng.randn(3, 4)))
    assert (v.max(1) >= -v.min(1)).all()
    m = rng.randn(5, 5)
    m = m + m.T
    assert np.allclose(unpack(pack(m), 5), m)
    assert np.linalg.eigvalsh(nearest_psd(m))[0] > 0


def test_statistics_give_the_scanned_errors(spark, rng):
    x = rng.randn(60, 6) @ rng.randn(6, 6)
    f = frame(spark, [x[:20], x[20:]])
    m = estimator("P-COV", 2).fit(f).model
    scanned = metrics.reconstruction_errors(f, m).first()
    assert scanned["mse"] == pytest.approx(metrics.mse_from_moments(Moments.of(x), m))
    assert metrics.per_sample_error(f, m).agg({"error": "avg"}).first()[0] == pytest.approx(scanned["mse"])
    assert metrics.variance_retention(Moments.of(x), m) == pytest.approx(m.explained_variance_ratio.sum())
    with pytest.raises(ValueError):
        metrics.reconstruction_error(f, m, "other")


def test_heterogeneity_levels(spark, rng):
    same = frame(spark, [rng.randn(300, 12) for _ in range(4)])
    far = frame(spark, [rng.randn(100, 12) * (1 + 3 * k) + 5 * k for k in range(4)])
    low, high = adaptive.heterogeneity(party_stats(same)), adaptive.heterogeneity(party_stats(far))
    assert low["score"] < high["score"] and high["level"] == "high"
    est = adaptive.Adaptive(3).fit(far)
    assert est.chosen.name == "P-COV" and "high" in est.selection_report()
    assert adaptive.Adaptive(3, force_method="AP-STACK").fit(far).chosen.name == "AP-STACK"
    with pytest.raises(ValueError):
        adaptive.Adaptive(3, force_method="x")


def test_spectrum_divergence_is_kl(spark, rng):
    parts = [rng.randn(80, 5) * np.array([1, 2, 3, 4, 5]), rng.randn(60, 5)]
    got = adaptive.heterogeneity(party_stats(frame(spark, parts)), 50)["metrics"]["spectrum_divergence"]
    spectra = [np.linalg.eigvalsh(np.cov(p.T, bias=True))[::-1][:4] for p in parts]
    spectra = [s / (s.sum() + 1e-8) for s in spectra]
    mean = np.mean(spectra, axis=0)
    want = np.mean([np.sum((s + 1e-10) * np.log((s + 1e-10) / (mean + 1e-10))) for s in spectra])
    assert got == pytest.approx(want)


def test_streaming_equals_recompute(spark, rng):
    x = [rng.randn(n, 9) + k for k, n in enumerate((50, 60, 40, 20))]
    s = StreamingPCA(3).fit(frame(spark, x[:3]))

    def check(rows):
        values = np.linalg.eigvalsh(np.cov(np.concatenate(rows).T, bias=True))[::-1][:3]
        assert np.allclose(s.model.explained_variance, values)

    check(x[:3])
    s.add_client("late", Moments.of(x[3]))
    check(x)
    s.update_client("late", Moments.of(x[0]), "append")
    check([*x, x[0]])
    s.update_client("late", Moments.of(x[1]), "replace")
    check([*x[:3], x[1]])
    s.remove_client("late")
    check(x[:3])
    assert s.contribution("0") == pytest.approx(50 / 150) and s.contribution("none") == 0
    for bad in (lambda: s.add_client("0", Moments.of(x[0])), lambda: s.update_client("none", Moments.of(x[0])), lambda: s.update_client("0", Moments.of(x[0]), "mode"), lambda: s.remove_client("none")):
        with pytest.raises(ValueError):
            bad()
    for c in list(s.clients):
        s.remove_client(c)
    counter = s.update_counter
    with pytest.raises(ValueError):
        s.model  # noqa: B018
    assert counter == len(s.history) and s.status(spark).first()["fitted"] is False


def test_accountant():
    a = privacy.Accountant(1.0, 1e-5)
    a.spend(0.7, 1e-6)
    assert a.can_spend(0.3) and not a.can_spend(0.4)
    with pytest.raises(ValueError):
        a.spend(0.4)
    assert a.summary()["n_queries"] == 1


@pytest.mark.parametrize("bad", [(0, 0.1), (1, 0), (1, 1)])
def test_noise_scale_bounds(bad):
    with pytest.raises(ValueError):
        privacy.noise_scale(1, *bad)


def test_private_fit(spark, rng):
    f = frame(spark, [rng.randn(400, 6) * [5, 1, 1, 1, 1, 1] for _ in range(3)])
    est = privacy.PrivatePCA(2, 1, epsilon=1e6, delta=1e-5).fit(f)
    clipped = estimator("P-COV", 2).fit(privacy.clip(f, est.clip_bound)).model
    assert metrics.principal_angles(est.model.components[:1], clipped.components[:1]).max() < 1e-2
    assert len(est.noise_info) == 3 and est.accountant.remaining()[0] == 0
    with pytest.raises(ValueError):
        est.fit(f)  # the budget is spent
    norms = [np.linalg.norm(r["features"]) for r in privacy.clip(f, 2.0).collect()]
    assert max(norms) <= 2.0 + 1e-9
    whole = privacy.clip(f, 10.0, per_sample=False).collect()
    assert np.linalg.norm([r["features"] for r in whole]) == pytest.approx(10.0)


def test_same_seed_same_noise(spark, rng):
    f = frame(spark, [rng.randn(50, 4) for _ in range(2)])
    a, b = (privacy.PrivatePCA(2, 5, clip_bound=2.0).fit(f).model for _ in range(2))
    assert np.array_equal(a.components, b.components)


@pytest.mark.parametrize("method,params", [("none", {}), ("low_rank", {"rank": 4}), ("sketch", {"sketch": 60}), ("quantize", {"bits": 8}), ("quantize", {"bits": 16}), ("quantize", {"bits": 32}), ("top_k", {"k": 60}), ("combined", {"rank": 4})])
def test_codecs(rng, method, params):
    x = rng.randn(200, 10) * np.arange(1, 11)
    c = np.cov(x.T, bias=True)
    made, _ = compression.codec(method, **params)
    back = made.decompress(made.compress(c), 10)
    assert back.shape == c.shape and np.allclose(back, back.T, atol=1e-2 * np.abs(c).max())
    limit = {"none": 1e-12, "top_k": 1e-12, "sketch": 1.5}.get(method, 0.4)
    assert np.linalg.norm(back - c) / np.linalg.norm(c) <= limit
    s = compression.compression_stats(method, 3072)
    assert s["total_bits"] == s["compressed_size"] * s["bits_per_value"] + 64 * 3072 + 64


def test_codec_options(rng):
    c = np.cov(rng.randn(50, 6).T, bias=True)
    trunc, near = (compression.Quantize(8, r).decompress(compression.Quantize(8, r).compress(c), 6) for r in ("trunc", "nearest"))
    assert np.abs(near - c).max() < np.abs(trunc - c).max()
    p = compression.LowRank(2)
    assert np.trace(p.decompress(p.compress(c), 6)) == pytest.approx(np.trace(c))
    with pytest.raises(ValueError):
        compression.codec("zip")
    with pytest.raises(ValueError):
        compression.Quantize(12)
    flat = compression.Quantize(8)
    assert np.allclose(flat.decompress(flat.compress(np.ones((3, 3))), 3), 1)


def test_compressed_fit(spark, rng):
    f = frame(spark, [rng.randn(100, 8) * np.arange(1, 9) + k for k in range(3)])
    truth = estimator("P-COV", 2).fit(f).model
    for method in compression.METHODS:
        est = compression.CompressedPCA(2, method=method, rank=8, sketch=400, top_k=40).fit(f)
        assert metrics.alignment_score(truth.components, est.model.components) > (0.8 if method == "sketch" else 0.97)
        assert "ratio" in est.compression_report()

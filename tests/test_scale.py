"""Trees of merges, state of streams, exact paths beside bounded ones."""

import gzip
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eigenweave.operators import downstream, kernel, privacy, stats
from eigenweave.operators.combine import pooled_moments
from eigenweave.operators.estimators import estimator
from eigenweave.operators.iterate import subspace_iteration
from eigenweave.plans import demos, experiment
from eigenweave.plans.queries import ORACLES, QUERIES, client_table, run_client_stream
from eigenweave.sources import images
from eigenweave.sources.partition import DataPartitioner
from eigenweave.sources.scratch import scratch
from eigenweave.sources.sinks import put_bytes
from eigenweave.streaming import events, incremental
from helpers import agrees, duck, frame, norm

SF = "/root/testdata/sf0.001"


def test_statistics_merge_in_a_tree(spark, rng, monkeypatch):
    x = rng.randn(700, 12)
    rows = frame(spark, [x[:300], x[300:650], x[650:]]).repartition(23)
    monkeypatch.setattr(stats, "FAN_IN", 3)
    monkeypatch.setattr(stats, "tasks_of", lambda df: 23)
    got = {r["party"]: stats.as_moments(r) for r in stats.party_stats(rows).collect()}
    assert set(got) == {0, 1, 2}
    for k, part in enumerate((x[:300], x[300:650], x[650:])):
        assert got[k].n == len(part) and np.allclose(got[k].mean, part.mean(0)) and np.allclose(got[k].cov, np.cov(part.T, bias=True))
    whole = pooled_moments(stats.party_stats(rows))
    assert whole.n == 700 and np.allclose(whole.cov, np.cov(x.T, bias=True))


@pytest.mark.parametrize("d", [3, 12])
def test_nulls_raise_at_any_number_of_features(spark, d):
    good = [1.0] * d
    for bad in (None, [None, *good[1:]]):
        df = spark.createDataFrame([(0, good), (0, bad)], "party int, features array<double>")
        with pytest.raises(Exception, match="null v"):
            stats.party_stats(df, d).collect()


def test_a_null_party_is_a_party(spark, rng):
    rows = [(None if k % 3 == 0 else k % 3, [float(v) for v in rng.randn(10)]) for k in range(60)]
    got = {r["party"]: r["n"] for r in stats.party_stats(spark.createDataFrame(rows, "party int, features array<double>")).collect()}
    assert got == {None: 20, 1: 20, 2: 20}


def test_wide_subspace_iteration_makes_no_matrix(spark, rng, monkeypatch):
    x = rng.randn(400, 20) * np.linspace(4, 0.2, 20)
    rows = frame(spark, [x[:150], x[150:]])
    held = subspace_iteration(rows, 3, 300, 1e-9, 5)
    monkeypatch.setattr("eigenweave.operators.iterate.pooled_moments", lambda *_: 1 / 0)
    monkeypatch.setattr("eigenweave.operators.estimators.MATRIX_DIMS", 10)
    wide = subspace_iteration(rows, 3, 300, 1e-9, 5, matrix_dims=10)
    assert np.allclose(held.components, wide.components, atol=1e-6) and np.allclose(held.explained_variance, wide.explained_variance) and np.allclose(held.explained_variance_ratio, wide.explained_variance_ratio)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, rng, share):
    for values in (rng.rand(5000), rng.randint(0, 4, 5000).astype(float), np.concatenate((np.zeros(4000), rng.rand(7))), np.array([2.5])):
        df = spark.createDataFrame(pd.DataFrame({"v": values}))
        assert privacy.exact_percentile(df, share, held=50) == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert privacy.exact_percentile(spark.createDataFrame([], "v double"), share) is None


def test_clients_beyond_the_driver_memory_go_to_tables(spark, rng):
    x = rng.randn(300, 5)
    parts = {f"c{k}": stats.Moments.of(x[30 * k : 30 * k + 30]) for k in range(10)}
    run = incremental.StreamingPCA(2)
    run.clients = incremental.Clients(held_bytes=3 * 8 * 25)
    for name, m in parts.items():
        run.add_client(name, m, recompute=False)
    assert len(run.clients._own) <= 3 and len(run.clients) == 10 and run.clients["c1"].n == 30
    run.update_client("c1", parts["c2"], "replace").remove_client("c9")
    run.recompute()
    want = np.concatenate([x[:30], x[60:90], x[60:270]])
    assert run.total.n == 270 and np.allclose(run.total.cov, np.cov(want.T, bias=True))
    assert run.contribution("c1") == pytest.approx(1 / 9) and run.contribution("c9") == 0


def event_files(tmp_path, files):
    source = spark_dir = tmp_path / "events"
    source.mkdir()
    for k, rows in enumerate(files):
        path = source / f"{k}.parquet"
        pd.DataFrame(rows).to_parquet(path)
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    return str(spark_dir)


def test_stream_over_many_batches_equals_sql(spark, tmp_path):
    table = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id")
    files = [table[i : i + 137] for i in range(0, len(table), 137)]
    folder = event_files(tmp_path, files)
    schema = spark.read.parquet(folder).schema
    path = scratch(spark, "stream")
    run_client_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), path)
    from eigenweave.plans.queries import ORACLES

    names, want = duck(ORACLES["e3_stream_of_events"], SF)
    got = client_table(spark, path)
    assert norm(tuple(r[c] for c in names) for r in got.collect()) == norm(want)
    assert len(events.versions(spark, f"{path}/changes")) == len(files) and len(events.versions(spark, f"{path}/current")) == 2
    assert spark.read.parquet(f"{path}/changes").where("status = 'rejected'").count() == 0


def test_late_and_impossible_events_come_out_as_rejected(spark, tmp_path):
    event = lambda seq, op, mode, client, *x: [{"seq": seq, "op": op, "mode": mode, "client_id": client, "features": [float(v), 1.0]} for v in x or (0,)]
    files = [
        event(1, "add", "", "a", 1, 2) + event(1, "add", "", "b", 5, 6),
        event(1, "add", "", "a", 3) + event(3, "update", "append", "a", 4) + event(2, "update", "replace", "c", 9),  # the first goes on with a's event
        event(2, "update", "append", "a", 99) + event(3, "update", "append", "a", 5) + event(4, "add", "", "b", 7) + event(5, "remove", "", "b") + event(6, "merge", "", "a", 1),
        event(5, "remove", "", "b") + event(6, "update", "append", "b", 1) + event(7, "add", "", "b", 8, 10),
    ]
    folder = event_files(tmp_path, files)
    path = scratch(spark, "stream")
    ev = spark.readStream.schema(events.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    events.run_models(ev, 1, path, f"{path}-checkpoint").awaitTermination()
    got = {r["party"]: (r["n"], r["mean"][0]) for r in events.current(spark, path).collect()}
    assert got == {"a": (5, 3.0), "b": (2, 9.0)}
    log = spark.read.parquet(f"{path}/changes").where("status = 'rejected'").select("client_id", "seq", "reason").collect()
    assert sorted(tuple(r) for r in log) == [("a", 2, "late"), ("a", 6, "unknown operation"), ("b", 4, "exists"), ("b", 6, "unknown client"), ("c", 2, "unknown client")]


def test_rbf_machine_satisfies_its_conditions(rng):
    x = np.concatenate((rng.randn(80, 3), rng.randn(80, 3) + 1.2))
    y = np.repeat([1.0, -1.0], 80)
    k = kernel.rbf(x, x, 0.4)
    a, rho = kernel.solve(k, y, 1.0, 1e-6)
    margin = y * (k @ (a * y) - rho)
    assert abs((a * y).sum()) < 1e-9 and a.min() >= 0 and a.max() <= 1
    assert (margin[a < 1e-9] > 1 - 1e-4).all() and (margin[a > 1 - 1e-9] < 1 + 1e-4).all() and np.allclose(margin[(a > 1e-6) & (a < 1 - 1e-6)], 1, atol=1e-4)


def test_rbf_machine_on_frames(spark, rng):
    y = rng.randint(0, 3, 400)
    ring = np.stack((np.cos(rng.rand(400) * 6.3), np.sin(rng.rand(400) * 6.3))).T * 0 + (y[:, None] + 1) * (lambda t: np.stack((np.cos(t), np.sin(t))).T)(rng.rand(400) * 6.3) + 0.1 * rng.randn(400, 2)
    s = frame(spark, [ring], [y])
    train, test = s.where("row_id % 4 != 0"), s.where("row_id % 4 = 0")
    assert kernel.fits(train, "features")
    assert downstream.evaluate_classification(train, test, "svm").first()["accuracy"] > 0.97  # rings: no linear machine does that
    assert downstream.evaluate_classification(train, test, "svm", exact=False, width=64, max_iter=30).first()["accuracy"] > 0.8


def test_neighbours_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(downstream, "TRAIN_BLOCK", 40)
    x = np.concatenate((np.ones((200, 3)) * 1e6, np.ones((60, 3)) * (1e6 + 1e-3)))
    s = frame(spark, [x])
    got = downstream.nearest(s, s.where("row_id = 250"), 7).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == list(range(200, 207)) and all(r["distance"] == 0 for r in got)
    got = downstream.nearest(s, s.where("row_id = 5"), 7).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == list(range(7))


def test_neighbours_of_all_blocks_meet_in_many_partitions(spark, monkeypatch):
    """Small shuffles are merged into one partition by default, where blocks meet however they are dealt."""
    for name, n in (("TRAIN_BLOCK", 90), ("TEST_BLOCK", 30)):
        monkeypatch.setattr(downstream, name, n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("h15_knn", "h15_knn_metrics"):
            assert agrees(QUERIES[name](spark, SF), ORACLES[name], SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_neighbours_tie_as_in_sql_and_nan_comes_last(spark, rng, tmp_path):
    v = rng.randn(64).astype(np.float32)
    x = np.array([rng.permutation(v) for _ in range(200)])  # as far from zero, but for the order of the sum
    x[::5] = 0
    x[7::20, 3], x[9::20, 5], x[15::20, 2] = np.nan, np.inf, np.nan
    few = rng.randn(12, 64).astype(np.float32)
    few[[1, 2, 3, 4, 6, 7], 0] = np.nan  # fewer than five neighbours are at a distance
    for name, rows in (("many", x), ("few", few)):
        table = [(k, [float(c) for c in r], int(k * 7 % 10)) for k, r in enumerate(rows)]
        spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert agrees(QUERIES["h15_knn"](spark, f"{tmp_path}/{name}"), ORACLES["h15_knn"], f"{tmp_path}/{name}")


def test_exact_splits_are_equal(spark, rng):
    rows = [(0, k, [1.0], int(rng.randint(0, 3)) if k % 50 else None) for k in range(1003)]
    s = spark.createDataFrame(rows, "party int, row_id long, features array<double>, label int")
    p = DataPartitioner(5, 4)
    for kind in ("iid", "shard"):
        out = p.partition(s, kind, exact=True)
        sizes = [r["count"] for r in out.groupBy("party").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2 and out.columns == s.columns and sum(sizes) == 1003
    assert sorted(p.partition(s, "iid", exact=True).collect()) == sorted(p.partition(s.repartition(6), "iid", exact=True).collect())


def test_image_files(spark, tmp_path):
    x = np.arange(2 * 3 * 2, dtype=np.uint8).reshape(2, 3, 2)
    raw = struct.pack(">4B3I", 0, 0, 8, 3, 2, 3, 2) + x.tobytes()
    assert (images.parse_idx(raw) == x).all() and (images.parse_idx(gzip.compress(raw)) == x).all()
    assert images.parse_idx(struct.pack(">4BI", 0, 0, 0x0D, 1, 2) + np.array([1.5, -2], ">f4").tobytes()).tolist() == [1.5, -2.0]
    for bad in (b"", b"\0\0\x07\x01", raw[:-1], b"PNG" * 9):
        with pytest.raises(ValueError):
            images.parse_idx(bad)
    put_bytes(spark, f"file://{tmp_path}/bad.bin", b"x" * 100)
    with pytest.raises(Exception, match="not whole records"):
        images.load_records(spark, f"file://{tmp_path}/bad.bin").collect()


@pytest.mark.parametrize("name", sorted(demos.DEMOS))
def test_demos(spark, name):
    rows = demos.DEMOS[name](spark).collect()
    assert len(rows) >= 3
    if name == "agreement":
        angle = {r["method"]: r["angle"] for r in rows}
        assert angle["P-COV"] < 1e-6 and angle["SUB-IT"] < 1 and angle["AP-COV"] < 10


def test_command_line(spark, tmp_path, capsys):
    from eigenweave.__main__ import main

    main(["--demo", "streaming", "--out", f"file://{tmp_path}/demo"])
    assert "remove 2" in capsys.readouterr().out and spark.read.parquet(f"file://{tmp_path}/demo").count() == 6
    main(["--data", SF, "--dataset", "embeddings", "--partition", "dirichlet", "--num-clients", "3", "--n-components", "2", "--methods", "P-COV"])
    assert "P-COV" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([])


class Charts:
    """Stands in for pyplot: notes what is drawn."""

    def __init__(self):
        self.calls = []

    def subplots(self):
        return self, self

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args))
            return self

        return call


@pytest.mark.parametrize("kind,call,times", [("line", "plot", 2), ("scatter", "scatter", 2), ("bar", "bar", 2), ("heat", "imshow", 1)])
def test_charts(kind, call, times):
    rows, plt = pd.DataFrame({"x": [2, 1, 2, 1], "y": [1.0, 2.0, 3.0, 4.0], "method": ["a", "a", "b_c", "b_c"]}), Charts()
    experiment.draw_chart(plt, rows, "f.png", "x", "y", "method", kind)
    names = [n for n, _ in plt.calls]
    assert names.count(call) == times and "savefig" in names
    if kind == "line":
        assert [list(args[0]) for n, args in plt.calls if n == "plot"] == [[1, 2], [1, 2]]
    with pytest.raises(ValueError):
        experiment.draw_chart(plt, rows, "f.png", "x", "y", "method", "pie")


def test_generated_values(spark):
    from eigenweave.sources import generate

    x = np.array([r["features"] for r in generate.block_rows(spark, 3000, 30, 2, 1, width=5, height=1.5, noise=0.3).collect()])
    assert np.allclose(x.mean(0), [1.5 * (10 <= k < 15) for k in range(30)], atol=0.03) and np.allclose(x.std(0), 0.3, atol=0.02)
    b = generate.blobs(spark, 4000, 6, 3, seed=9, spread=2.0, noise=0.25)
    means = np.random.RandomState(9).randn(3, 6) * 2.0
    for r in b.groupBy("label").agg(F.array(*(F.avg(F.col("features")[i]) for i in range(6))).alias("m"), F.stddev(F.col("features")[0]).alias("s")).collect():
        assert np.allclose(r["m"], means[r["label"]], atol=0.05) and r["s"] == pytest.approx(0.25, abs=0.03)
    n = np.array([r["features"] for r in generate.normal_parties(spark, 2, 2000, 4).collect()])
    assert np.allclose(np.cov(n.T), np.eye(4), atol=0.1)
    i = np.array([r["features"] for r in generate.image_like(spark, 3000, 40, 1, length=5.0).collect()])
    c = np.corrcoef(i.T)
    assert c[10, 11] == pytest.approx(np.exp(-1 / 5), abs=0.05) and abs(c[5, 35]) < 0.1


def test_shared_folder_is_needed_on_a_cluster():
    from eigenweave.sources.scratch import shared_dir

    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Far)


def test_methods_still_agree(spark, rng):
    x = rng.randn(300, 10) * np.linspace(3, 0.3, 10)
    rows = frame(spark, [x[:100], x[100:]])
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]
    for m in ("P-COV", "Centralized", "SUB-IT"):
        assert np.allclose(estimator(m, 3, 1).fit(rows).model.explained_variance, want, rtol=1e-4)

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenweave import functions as sql_functions
from eigenweave.operators import downstream
from eigenweave.sources import generate
from eigenweave.sources import samples as src
from eigenweave.sources.partition import DataPartitioner, partition_stats
from eigenweave.sources.sinks import flatten, read_csv, results_frame, write
from eigenweave.streaming import events
from helpers import frame


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.RandomState(0)
    y = rng.randint(0, 4, 2000)
    return frame(spark, [np.eye(4)[y] * 5 + rng.randn(2000, 4)], [y]).cache()


@pytest.mark.parametrize("kind,params", [("iid", {}), ("dirichlet", {"alpha": 0.3}), ("shard", {}), ("quantity", {}), ("quantity_skew", {"power": 2.0})])
def test_partitions_place_every_row_alike(labelled, kind, params):
    p = DataPartitioner(5, 3)
    a = {r["row_id"]: r["party"] for r in p.partition(labelled, kind, **params).collect()}
    b = {r["row_id"]: r["party"] for r in p.partition(labelled.repartition(7), kind, **params).collect()}
    assert a == b and len(a) == 2000 and set(a.values()) <= set(range(5))


def test_partition_shapes(labelled):
    sizes = lambda kind, **k: sorted(r["count"] for r in DataPartitioner(4, 1).partition(labelled, kind, **k).groupBy("party").count().collect())
    iid, skew = sizes("iid"), sizes("quantity", power=2.0)
    assert min(iid) > 400 and max(skew) > 2 * min(skew)
    stats = lambda kind, **k: partition_stats(DataPartitioner(4, 1).partition(labelled, kind, **k)).first()
    assert stats("iid")["mean_emd"] < stats("shard")["mean_emd"]
    assert stats("dirichlet", alpha=100.0)["mean_emd"] < stats("dirichlet", alpha=0.1)["mean_emd"]
    with pytest.raises(ValueError):
        DataPartitioner(4).partition(labelled, "other")


def test_generators_do_not_depend_on_partitioning(spark):
    a = generate.blobs(spark, 5000, 8, 3, seed=1)
    b = generate.blobs(spark, 9000, 8, 3, seed=1)
    first = lambda f: f.where("row_id < 10").orderBy("row_id").collect()
    assert first(a) == first(b) and a.count() == 5000
    x = generate.block_parties(spark, [30, 20], 40, seed=5, width=5)
    got = x.groupBy("party").agg(F.avg(F.col("features")[0]).alias("first"), F.avg(F.col("features")[6]).alias("seventh")).orderBy("party").collect()
    assert got[0]["first"] > 1 > got[1]["first"] and got[1]["seventh"] > 1 > got[0]["seventh"]
    assert generate.image_like(spark, 50, 36, 2).count() == 50


def test_zscore_and_sampling(labelled):
    (z,) = src.zscore(labelled)
    got = z.agg(F.avg(F.col("features")[0]), F.stddev_pop(F.col("features")[3])).first()
    assert abs(got[0]) < 1e-9 and got[1] == pytest.approx(1, abs=1e-6)
    a, b = (sorted(r["row_id"] for r in src.sample_rows(f, 50, 9).collect()) for f in (labelled, labelled.repartition(5)))
    assert a == b and len(set(a)) == 50


def test_nearest_neighbours_equal_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(downstream, "TRAIN_BLOCK", 37)
    monkeypatch.setattr(downstream, "TEST_BLOCK", 11)
    x, y = rng.randint(0, 4, (120, 3)).astype(float), rng.randint(0, 4, (30, 3)).astype(float)
    train, test = frame(spark, [x]), frame(spark, [y])
    got = {(r["row_id"], r["rank"]): r["neighbour"] for r in downstream.nearest(train, test, 4).collect()}
    for i, v in enumerate(y):
        far = np.sqrt(((x - v) ** 2).sum(1))
        want = sorted(range(120), key=lambda j: (far[j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == want


@pytest.mark.parametrize("classifier", ["knn", "logistic", "svm"])
def test_classifiers_learn_blobs(labelled, classifier):
    train, test = labelled.where("row_id % 4 != 0"), labelled.where("row_id % 4 = 0")
    got = downstream.evaluate_classification(train, test, classifier, width=64).first()
    assert got["accuracy"] > 0.9 and got["f1"] > 0.9


def test_metrics_with_absent_classes(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    got = downstream.classification_metrics(p).first()
    assert got["accuracy"] == 0.5 and got["recall"] == 0.5
    assert got["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)


def test_sinks(spark, tmp_path):
    nested = {"a": {"b": 1, "c": 2.5}, "d": 3, "name": "x"}
    assert sorted(flatten(nested)) == [("", "d", 3.0), ("a", "b", 1.0), ("a", "c", 2.5)]
    for kind in ("csv", "parquet", "json"):
        write(results_frame(spark, nested), f"file://{tmp_path}/{kind}", kind)
    assert read_csv(spark, f"file://{tmp_path}/csv", "path string, metric string, value double").count() == 3
    with pytest.raises(ValueError):
        write(results_frame(spark, nested), f"file://{tmp_path}/x", "xls")


def test_scratch(spark):
    import os

    from eigenweave.sources.scratch import clear_scratch, scratch

    a, b = scratch(spark, "x"), scratch(spark, "x")
    assert a != b
    spark.range(3).write.parquet(a)
    assert os.path.isdir(a.removeprefix("file://"))
    clear_scratch(spark)
    assert not os.path.exists(a.removeprefix("file://"))


def test_package_is_shipped_once(spark, monkeypatch):
    from eigenweave.sources import ship

    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.setattr(ship, "_shipped", set())
    ship.ship(spark)
    ship.ship(spark)
    assert spark.range(4).repartition(2).mapInPandas(lambda it: it, "id long").count() == 4 and len(ship._shipped) == 1


def test_sql_functions(spark):
    sql_functions.register(spark)
    got = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_norm(array(3D, 4D)) AS n, vec_clip(array(3D, 4D), 1D) AS c, pca_project(array(2D, 3D), array(1D, 1D), array(array(1D, 0D), array(0D, 2D))) AS p").first()
    assert got["d"] == 11 and got["n"] == 5 and got["p"] == [1.0, 4.0] and np.allclose(got["c"], [0.6, 0.8])


def test_client_events(spark, rng, tmp_path):
    x = {c: rng.randn(30, 5) + i for i, c in enumerate("abc")}
    ev = lambda seq, op, mode, c, m: [(seq, op, mode, c, [float(v) for v in row]) for row in m]
    rows = ev(1, "add", "", "a", x["a"]) + ev(2, "add", "", "b", x["b"]) + ev(3, "add", "", "c", x["c"]) + ev(4, "update", "append", "a", x["b"][:7])
    rows += [(5, "remove", "", "b", None), (6, "update", "append", "zz", [0.0] * 5)] + ev(7, "update", "replace", "c", x["a"][:9]) + ev(8, "add", "", "a", x["b"][:3])
    base = f"file://{tmp_path}"
    spark.createDataFrame(rows, events.EVENTS).write.parquet(f"{base}/in/one")
    read = lambda: spark.readStream.schema(events.EVENTS).option("recursiveFileLookup", True).parquet(f"{base}/in")
    events.run_models(read(), 2, f"{base}/out", f"{base}/check").awaitTermination()
    log = {(r["client_id"], r["status"], r["n"]) for r in spark.read.parquet(f"{base}/out/changes").collect()}
    assert log == {("a", "current", 37), ("a", "rejected", 0), ("b", "removed", 0), ("c", "current", 9), ("zz", "rejected", 0)}
    model = events.latest_model(spark, f"{base}/out", 0)
    want = np.concatenate((x["a"], x["b"][:7], x["a"][:9]))
    assert np.allclose(model.explained_variance, np.linalg.eigvalsh(np.cov(want.T, bias=True))[::-1][:2])
    spark.createDataFrame(ev(9, "update", "append", "c", x["c"]), events.EVENTS).write.parquet(f"{base}/in/two")
    events.run_models(read(), 2, f"{base}/out", f"{base}/check").awaitTermination()  # resumes from the checkpoint
    assert events.latest_model(spark, f"{base}/out", 1).n_samples == 37 + 9 + 30

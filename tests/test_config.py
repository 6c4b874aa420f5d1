import logging

import numpy as np
import pytest

from kinweave.operators import mediator, pairs
from kinweave.plans import baselines, cluster
from kinweave.plans.config import Config, run_log
from kinweave.sources import files, shared


def clouds(spark, n=90, seed=4):
    """Three clouds of unit vectors seen by two models."""
    r = np.random.default_rng(seed)
    truth = [i % 3 for i in range(n)]

    def model(noise):
        centres = np.eye(3)
        rows = [(i, (centres[c] + noise * r.normal(size=3)).tolist()) for i, c in enumerate(truth)]
        return spark.createDataFrame(rows, "id long, embedding array<double>").cache()

    return {"base": model(0.25), "other": model(0.3)}, spark.createDataFrame(list(enumerate(truth)), "id long, label int")


CONFIG = Config(base="base", committee=("other",), k=8, th=0.5, max_sz=40)


def rows(labels):
    return sorted(map(tuple, labels.collect()))


def test_tables_are_kept_under_their_settings(spark, tmp_path, monkeypatch):
    features, _ = clouds(spark)
    calls, plain = [], cluster.knn
    monkeypatch.setattr(cluster, "knn", lambda *a, **o: calls.append(a) or plain(*a, **o))
    fresh = rows(cluster.run_config(CONFIG, features).labels)
    first = rows(cluster.run_config(CONFIG, features, cache=str(tmp_path)).labels)
    assert first == fresh and len(calls) == 4
    assert rows(cluster.run_config(CONFIG, features, cache=str(tmp_path)).labels) == first and len(calls) == 4
    cluster.run_config(CONFIG.but(th=0.6), features, cache=str(tmp_path))  # the same lists, other pairs
    assert len(calls) == 4
    cluster.run_config(CONFIG.but(k=5), features, cache=str(tmp_path))
    assert len(calls) == 6


def test_mediator_is_trained_if_missing(spark, tmp_path, monkeypatch):
    features, truth = clouds(spark)
    train_features, train_truth = clouds(spark, seed=5)
    config, cache = CONFIG.but(strategy="mediator", th=0.4, validate=0.3), str(tmp_path / "cache")
    trained, plain = [], mediator.train_rounds
    monkeypatch.setattr(mediator, "train_rounds", lambda *a, **o: trained.append(1) or plain(*a, **o))
    with pytest.raises(ValueError, match="labelled"):
        cluster.run_config(config, features, cache=cache)
    with run_log(spark, str(tmp_path / "run.log")):
        first = cluster.run_config(config, features, None, train_features, train_truth, cache)
    text = (tmp_path / "run.log").read_text()
    assert "mediator, round 2" in text and "rel_recall" in text and "propagation" in text
    again = cluster.run_config(config, features, cache=cache)  # no labelled set needed
    assert rows(first.labels) == rows(again.labels) and len(trained) == 1
    cluster.run_config(config.but(force_retrain=True), features, None, train_features, train_truth, cache)
    assert len(trained) == 2
    assert first.score(truth).first().prec > 50  # a third by chance
    assert logging.getLogger("kinweave").handlers == []


def test_validation_improves_over_rounds(spark):
    features, truth = clouds(spark)
    lists = {m: cluster.knn(t, 8).cache() for m, t in features.items()}
    found = pairs.pair_set(lists["base"], {"other": lists["other"]}, features, truth=truth).cache()
    columns = pairs.feature_columns("base", ["other"])
    model, history = mediator.train_rounds(found, found, columns, 0.5, rounds=3, max_iter=60)
    assert len(history) == 3 and history[-1]["acc"] >= history[0]["acc"] - 0.02 and history[-1]["acc"] > 0.8
    assert mediator.validate(model, found, 0.5).first().asDict() == history[-1]


def test_baseline_command(spark, tmp_path, capsys):
    features, truth = clouds(spark)
    data = tmp_path / "data"
    (data / "features").mkdir(parents=True)
    np.array([r.embedding for r in features["base"].orderBy("id").collect()], dtype="<f4").tofile(data / "features" / "m.bin")
    (data / "meta.txt").write_text("".join(f"{r.label}\n" for r in truth.orderBy("id").collect()))
    out = str(tmp_path / "out")
    baselines.main([str(data), "m", "kmeans", "clusters=3", "--dims", "3", "--out", out, "--evaluate"])
    said = capsys.readouterr().out
    assert '"clusters": 3' in said and "fscore" in said
    kept = rows(files.read_labels(spark, f"{out}/kmeans-clusters-3/meta"))
    assert len(kept) == 90 and kept[0][1] == 0
    baselines.main([str(data), "m", "kmeans", "clusters=3", "--dims", "3", "--out", out])
    assert rows(files.read_labels(spark, f"{out}/kmeans-clusters-3/meta")) == kept
    assert baselines.result_path("o/", "dbscan", {"min_samples": 3, "eps": 0.75}) == "o/dbscan-eps-0.75-min_samples-3/meta"


def test_large_feature_files_are_split(spark, tmp_path):
    x = np.arange(4000 * 8, dtype="<f4").reshape(-1, 8)
    x.tofile(tmp_path / "f.bin")
    conf, key = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "10000")  # no multiple of a row
    try:
        got = files.read_features(spark, str(tmp_path / "f.bin"), 8)
        assert got.rdd.getNumPartitions() > 5
        assert [r.embedding for r in got.orderBy("id").collect()] == x.tolist()
    finally:
        conf.unset(key)


def test_shared_folder_needs_a_name_off_local_masters(spark, monkeypatch):
    class Unset:
        master, applicationId = "spark://host:7077", "x"

        def get(self, key, default=None):
            return default

        def getConf(self):
            return self

    class Other:
        conf = sparkContext = Unset()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Other())
    outside = shared.materialize(spark.range(9), "t")
    with shared.recorded() as paths:
        tables = [shared.materialize(spark.range(i + 1), "t") for i in range(3)]
        with shared.recorded() as inner:
            tables.append(shared.materialize(spark.range(4), "t"))
    assert [t.kinweave_path for t in tables] == paths and paths[3:] == inner
    assert shared.release(spark, paths[:2]) == 2 and shared.release(spark, paths[:3]) == 1  # what is gone does not count
    assert tables[3].count() == 4 and outside.count() == 9
    shared.discard(tables[3], outside)
    assert shared.release(spark, paths) == 0

import pytest
from pyspark.sql import functions as F

from kinweave.operators import evaluate, mediator, pairs
from kinweave.plans.config import PRESETS, Config, RunningMean
from kinweave.plans.cluster import GraphClusterer, baseline, run_config, whitened_kmeans


def lists(spark, rows):
    """rows: {id: [(nbr, dist), ...]}"""
    return spark.createDataFrame([(i, k + 1, n, float(d)) for i, row in rows.items() for k, (n, d) in enumerate(row)], "id long, rank int, nbr long, dist double")


def test_threshold_is_strict_and_one_direction_is_enough(spark):
    base = lists(spark, {0: [(0, 0), (1, .5)], 1: [(1, 0), (2, .3)], 2: [(2, 0), (0, .9)]})
    assert {(r.a, r.b): r.score for r in pairs.vote_pairs(base, [], 0, .5).collect()} == {(1, 2): pytest.approx(.7)}
    assert {(r.a, r.b) for r in pairs.vote_pairs(base, [], 0, .49).collect()} == {(0, 1), (1, 2)}
    assert {tuple(r) for r in pairs.all_pairs(base).collect()} == {(0, 1), (1, 2), (0, 2)}


def test_votes_count_from_anchor_to_neighbour(spark):
    base = lists(spark, {0: [(0, 0), (1, .1)], 1: [(1, 0), (0, .2)]})
    member = lists(spark, {0: [(0, 0), (2, .1)], 1: [(1, 0), (0, .1)]})
    assert {(r.id, r.nbr): r.votes for r in pairs.votes(base, [member], 0).collect()} == {(0, 1): 0, (1, 0): 1}
    assert [(r.a, r.b, r.score) for r in pairs.vote_pairs(base, [member], 1, 0).collect()] == [(0, 1, pytest.approx(.8))]
    assert [(r.a, r.b, r.score) for r in pairs.vote_pairs(base, [], 0, 0).collect()] == [(0, 1, pytest.approx(.9))]
    with pytest.raises(ValueError):
        pairs.vote_pairs(base, [], 1, 0)


def test_features_and_ground_truth(spark):
    base = lists(spark, {0: [(0, 0), (1, .1)], 1: [(1, 0), (2, .2)], 2: [(2, 0), (1, .2)]})
    member = lists(spark, {0: [(0, 0), (2, .1)], 1: [(1, 0), (2, .1)], 2: [(2, 0), (0, .1)]})
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [1.0, 1.0], 5), (2, [0.0, 2.0], 6)], "id long, embedding array<double>, label int")
    found = {(r.a, r.b): r for r in pairs.pair_set(base, {"m": member}, {"base": vectors, "m": vectors}, truth=vectors).collect()}
    assert found[0, 1].rel_m == 0 and found[1, 2].rel_m == 1
    assert found[0, 1].aff_base == pytest.approx(.5**.5) and found[1, 2].aff_m == pytest.approx(.5**.5)
    assert found[0, 1].str_base == 1 and found[1, 2].str_base == 2 and found[0, 1].str_m == 1 and found[1, 2].str_m == 1
    assert found[0, 1].label == 1 and found[1, 2].label == 0
    assert [tuple(r) for r in pairs.ground_truth(pairs.labelled(pairs.all_pairs(base), vectors)).collect()] == [(0, 1, 1.0)]
    assert len(pairs.feature_columns("b", list("wxyz"))) == 14 and pairs.feature_columns("b", [], ("relationship",)) == []


def test_scores(spark):
    def both(truth, pred):
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(truth, pred))], "id long, label int, pred int")

    assert [round(x, 2) if x else x for x in evaluate.pairwise_fscore(both([0, 0, 1, 1], [0, 0, 0, 1])).first()] == [2, 6, 4, 33.33, 50, 40]
    alone = evaluate.pairwise_fscore(both([0, 0, 1], [0, 1, 2])).first()
    assert (alone.pk, alone.prec, alone.recall) == (0, None, 0)
    assert evaluate.fscore_removed(both([0, 0, 1], [3, 3, -1])).first().fscore == 100
    assert [tuple(r) for r in evaluate.dense_contingency(both([0, 0, 1], [0, 1, 1]), 0.5).orderBy("label").collect()] == [(0, 1.5, 1.5), (1, 0.5, 1.5)]
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, -1), (3, 2)], "id long, label int")
    assert tuple(evaluate.summary(labels).first()) == (4, 2, 1.5, 0.25)
    assert evaluate.cluster_count(labels).first()[0] == 3
    assert sorted(map(tuple, evaluate.cluster_sizes(labels, 4).collect())) == [(0, 2), (1, 0), (2, 1), (3, 0)]
    scored = spark.createDataFrame([(.9, 1.), (.8, 0.), (.2, 1.), (.1, 0.)], "score double, label double")
    assert tuple(evaluate.pair_metrics(scored, .5).first()) == (.5, .5, 1.0, .5, .5)
    with pytest.raises(ValueError):
        evaluate.paired(labels, labels.limit(2), check=True)
    assert evaluate.precision_at(spark.createDataFrame([([.1, .7, .2], 2), ([.5, .3, .2], 2)], "output array<double>, label int"), 2).first()[0] == 50


def test_network_forward_and_training(spark, tmp_path):
    x = spark.createDataFrame([([1.0, -2.0],)], "x array<double>")
    layers = [([[1.0, 0.0], [0.0, 1.0]], [0.5, 0.5]), ([[1.0, 1.0], [0.0, 2.0]], [0.0, 0.1])]
    import math
    assert x.select(mediator.forward(F.col("x"), layers)).first()[0] == pytest.approx(math.exp(.1) / (math.exp(1.5) + math.exp(.1)))
    rows = spark.range(400).select("id", (F.col("id") % 20 / 20.0).alias("f"), F.rand(1).alias("g")).withColumn("label", (F.col("f") > 0.5).cast("double")).withColumns({"a": F.col("id"), "b": F.col("id") + 1})
    model = mediator.train(rows, ["f", "g"])
    mediator.save(model, str(tmp_path / "model"))
    scored = mediator.infer(mediator.load(str(tmp_path / "model")), rows)
    assert evaluate.pair_metrics(scored, .5).first().acc > .95
    assert mediator.select(scored, .5).columns == ["a", "b", "score"]


def planted(spark, classes=6, size=8, seed=1):
    """Classes of vectors around distinct directions."""
    n = classes * size
    return spark.range(n).select("id", (F.col("id") % classes).cast("int").alias("label"), F.array(*[F.when(F.col("id") % classes == c, 1.0).otherwise(0.0) + F.randn(seed + c) * 0.1 for c in range(classes)]).alias("embedding")).localCheckpoint()


def test_whole_runs_recover_planted_classes(spark):
    df = planted(spark)
    found = GraphClusterer(k=10, th=.7, max_sz=20).fit(df)
    assert found.score(df).first().fscore > 95 and found.score(df, keep=True).first().prec > 95
    assert GraphClusterer(k=10, th=.7).fit_many([df, df]).score(df).first().fscore > 95
    assert GraphClusterer(k=1, th=.5).fit(df).labels.filter("label <> -1").count() == 0
    many = Config(base="x", committee=("y",), k=10, th=.5, max_sz=20)
    other = planted(spark, seed=50)
    assert run_config(many, {"x": df, "y": other}).score(df).first().fscore > 90
    assert run_config(many.but(strategy="groundtruth"), {"x": df, "y": other}, truth=df).score(df).first().prec == 100
    learnt = run_config(many.but(strategy="mediator", th=.5), {"x": df, "y": other}, train_features={"x": planted(spark, seed=90), "y": planted(spark, seed=130)}, train_truth=df)
    assert learnt.score(df).first().fscore > 90
    for method, options in {"kmeans": {"clusters": 6}, "fast_hac": {"cut": .5}, "dbscan": {"eps": .5, "min_samples": 3}, "knn_dbscan": {"k": 8, "min_samples": 3}, "aro": {"k": 8}, "hdbscan": {"min_size": 4}}.items():
        both = evaluate.paired(df, baseline(method, df, **options))
        assert evaluate.fscore_removed(both).first().prec > 80, method
    assert whitened_kmeans(df, 6, dims=6)[0].count() == 48
    with pytest.raises(ValueError):
        baseline("nope", df)


def test_config():
    assert Config.from_yaml("k: 7\ncommittee: [a, b]\n") == Config(k=7, committee=("a", "b"))
    assert Config().key() == Config().key() != Config(k=3).key()
    with pytest.raises(ValueError):
        Config.from_dict({"kk": 1})
    assert PRESETS["committee"].accept == 4
    mean = RunningMean(2)
    assert [mean.add(x) for x in (1, 3, 5)] == [1, 2, 4]

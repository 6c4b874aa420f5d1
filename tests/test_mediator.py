import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import mediator


def rows(spark, n=900, d=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    data = [(int(i), int(i + 1), *map(float, x[i]), int(y[i]), "extra") for i in range(n)]
    return spark.createDataFrame(data, "a long, b long, " + ", ".join(f"f{j} double" for j in range(d)) + ", label int, score_ string").repartition(4)


def plain_epochs(df, parts, batch, epochs, lr, steps, task):
    """The same by loops over collected rows, in the order of the hashes."""
    layers = mediator.first_layers(3)
    velocity = [tuple(np.zeros_like(v) for v in layer) for layer in layers]
    for epoch in range(epochs):
        held = df.select("*", F.xxhash64(F.lit(epoch), "a", "b").alias("h")).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts))).collect()
        ends = []
        for part in range(parts):
            own = sorted((r for r in held if r.part == part), key=lambda r: (r.h, r.a, r.b))
            w, v = [tuple(p.copy() for p in layer) for layer in layers], [tuple(p.copy() for p in layer) for layer in velocity]
            for at in range(0, len(own), batch):
                lot = own[at:at + batch]
                x, y = np.array([[r.f0, r.f1, r.f2] for r in lot]), np.array([r.label for r in lot])
                _, grads = mediator.gradients(w, x, y)
                rate = lr * 0.1 ** sum(s <= epoch for s in steps)
                for i in range(len(w)):
                    for j in range(2):
                        v[i][j][...] = 0.9 * v[i][j] + grads[i][j] + 1e-4 * w[i][j]
                        w[i][j][...] = w[i][j] - rate * v[i][j]
            ends.append((len(own), w, v))
        total = sum(n for n, _, _ in ends)
        layers = [tuple(sum(n * w[i][j] for n, w, _ in ends) / total for j in range(2)) for i in range(3)]
        velocity = [tuple(sum(n * v[i][j] for n, _, v in ends) / total for j in range(2)) for i in range(3)]
    return layers


@pytest.mark.parametrize("task, parts", [(10_000, 1), (300, 3)])
def test_epochs_equal_plain_loops(spark, task, parts):
    df = rows(spark)
    net, trace = mediator.train_sgd(df, ["f0", "f1", "f2"], batch=64, lr=0.05, epochs=3, lr_steps=(1,), task_rows=task)
    want = plain_epochs(df, parts, 64, 3, 0.05, (1,), task)
    for (w, b), (w2, b2) in zip(net.layers, want):
        assert np.allclose(w, w2) and np.allclose(b, b2)
    assert len(trace) == 3


def test_gradient():
    r = np.random.default_rng(1)
    layers, x, y = mediator.first_layers(4, 2), r.normal(size=(9, 4)), r.integers(0, 2, 9)
    loss, grads = mediator.gradients(layers, x, y)
    for i in range(3):
        for j in range(2):
            flat = layers[i][j].reshape(-1)
            for at in r.integers(0, flat.size, 4):
                was, h = flat[at], 1e-6
                flat[at] = was + h
                up = mediator.gradients(layers, x, y)[0]
                flat[at] = was - h
                down = mediator.gradients(layers, x, y)[0]
                flat[at] = was
                assert grads[i][j].reshape(-1)[at] == pytest.approx((up - down) / (2 * h), abs=1e-6)


def test_learns_saves_and_scores(spark, tmp_path):
    df = rows(spark, 1500)
    net, trace = mediator.train_sgd(df, ["f0", "f1", "f2"], epochs=30, lr=0.1, batch=32, lr_steps=())
    assert trace[-1] < 0.2 < trace[0]
    mediator.save(net, str(tmp_path / "net"))
    again = mediator.load(str(tmp_path / "net"))
    scored = mediator.infer(again, df)
    assert scored.columns == [*df.columns, "score"]
    got = scored.orderBy("a").collect()
    x = np.array([[r.f0, r.f1, r.f2] for r in got])
    assert np.allclose([r.score for r in got], net.score(x))
    column = mediator.forward(F.array("f0", "f1", "f2"), [(w.tolist(), b.tolist()) for w, b in net.layers])
    assert np.allclose([r[0] for r in df.orderBy("a").select(column).collect()], net.score(x))
    assert mediator.validate(net, df, 0.5).first().acc > 0.9


def test_odd_rows(spark):
    df = rows(spark, 5)
    nulls = df.unionByName(df.limit(2).withColumn("label", F.lit(None).cast("int"))).withColumn("f1", F.when(F.col("a") > 1, F.col("f1")))
    net, trace = mediator.train_sgd(nulls, ["f0", "f1", "f2"], epochs=1)
    assert len(trace) == 1 and mediator.infer(net, nulls).filter("score between 0 and 1").count() == 7
    empty, trace = mediator.train_sgd(df.limit(0), ["f0", "f1", "f2"])
    assert trace == [] and mediator.infer(empty, df.limit(0)).collect() == []

"""Learned pair selection: a small network scores pairs from their features.

``train_sgd`` fits a ReLU network by minibatches with momentum: tasks go through
the rows dealt to them from the same weights, and after each epoch weights and
velocities are averaged by rows, so one task's worth of rows is plain stochastic
gradient descent. ``train`` is spark.ml's perceptron on standardised inputs (its
hidden units are sigmoid). ``infer``, ``save`` and ``load`` take either;
``forward`` evaluates a ReLU network of given weights as a column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.vectors import affine, relu, softmax
from kinweave.operators.evaluate import pair_metrics


def train(pairs: DataFrame, features: list[str], label: str = "label", max_iter: int = 60, seed: int = 0) -> PipelineModel:
    """A d-3d-3d-2 perceptron over standardised features."""
    d = len(features)
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[d, 3 * d, 3 * d, 2], maxIter=max_iter, seed=seed),
    ]).fit(pairs)


def train_rounds(pairs: DataFrame, held_out: DataFrame, features: list[str], th: float, rounds: int = 3, label: str = "label", max_iter: int = 60, seed: int = 0) -> tuple[PipelineModel, list[dict]]:
    """``train`` in ``rounds`` that go on from one another; the classifier metrics on ``held_out`` after each."""
    d, history, weights = len(features), [], None
    inputs = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]).fit(pairs)
    ready = inputs.transform(pairs).select("scaled", label)
    for _ in range(rounds):
        net = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[d, 3 * d, 3 * d, 2], maxIter=max(1, max_iter // rounds), seed=seed)
        fitted = (net if weights is None else net.setInitialWeights(weights)).fit(ready)
        weights = fitted.weights
        model = PipelineModel(stages=[*inputs.stages, fitted])
        history.append(validate(model, held_out, th, label).first().asDict())
    return model, history


@dataclass
class PairNet:
    """A ReLU network over ``columns``; layers of (weights by output, bias), two outputs."""

    columns: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        z = _passes(self.layers, x)[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)


def _passes(layers: list, x: np.ndarray) -> list[np.ndarray]:
    """The inputs of all layers, and the last one's output."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w.T + b
        out.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
    return out


def gradients(layers: list, x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """(mean cross-entropy, its gradient by each layer's weights and bias) of the classes y."""
    held = _passes(layers, x)
    z = held[-1] - held[-1].max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    loss = -log_p[np.arange(len(y)), y].mean()
    back = np.exp(log_p)
    back[np.arange(len(y)), y] -= 1
    back /= len(y)
    out = []
    for i in range(len(layers) - 1, -1, -1):
        out.append((back.T @ held[i], back.sum(0)))
        if i:
            back = (back @ layers[i][0]) * (held[i] > 0)
    return float(loss), out[::-1]


def descend(layers: list, velocity: list, x: np.ndarray, y: np.ndarray, lr: float, momentum: float, decay: float) -> float:
    """One step on a batch, in place; the batch's loss."""
    loss, grads = gradients(layers, x, y)
    for (w, b), (vw, vb), (gw, gb) in zip(layers, velocity, grads):
        for value, speed, g in ((w, vw, gw), (b, vb, gb)):
            speed *= momentum
            speed += g + decay * value
            value -= lr * speed
    return loss


def first_layers(d: int, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """d-3d-3d-2, uniform within one over the root of the inputs."""
    r, sizes = np.random.default_rng(seed), [d, 3 * d, 3 * d, 2]
    return [(r.uniform(-1, 1, (o, i)) / np.sqrt(i), r.uniform(-1, 1, o) / np.sqrt(i)) for i, o in zip(sizes, sizes[1:])]


def _flat(layers: list) -> np.ndarray:
    return np.concatenate([v.ravel() for layer in layers for v in layer])


def _shaped(flat: np.ndarray, like: list) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for layer in like:
        own = []
        for v in layer:
            own.append(flat[at:at + v.size].reshape(v.shape).copy())
            at += v.size
        out.append(tuple(own))
    return out


def _epoch(start: np.ndarray, speed: np.ndarray, like: list, batch: int, lr: float, momentum: float, decay: float):
    """Sorted rows (part, label, features...) to (n, loss, state) of each part: its rows, their summed loss, weights and velocities after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, layers, velocity, n, loss, x, y = None, None, None, 0, 0.0, None, None

        def step(xs: np.ndarray, ys: np.ndarray) -> None:
            nonlocal n, loss
            loss += descend(layers, velocity, xs, ys, lr, momentum, decay) * len(ys)
            n += len(ys)

        def done() -> pa.RecordBatch:
            if len(y):
                step(x, y)
            state = np.concatenate([_flat(layers), _flat(velocity)]).tolist()
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([state], pa.list_(pa.float64()))], ["n", "loss", "state"])

        for rows in batches:
            parts, labels = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            features = np.stack([c.to_numpy() for c in rows.columns[2:]], axis=1)
            for p in np.unique(parts):
                if p != part:
                    if part is not None:
                        yield done()
                    part, layers, velocity, n, loss = p, _shaped(start, like), _shaped(speed, like), 0, 0.0
                    x, y = np.zeros((0, features.shape[1])), np.zeros(0, dtype=np.int64)
                mine = parts == p
                x, y = np.concatenate([x, features[mine]]), np.concatenate([y, labels[mine]])
                whole = len(y) // batch * batch
                for at in range(0, whole, batch):
                    step(x[at:at + batch], y[at:at + batch])
                x, y = x[whole:], y[whole:]
        if part is not None:
            yield done()

    return run


def train_sgd(
    pairs: DataFrame, features: list[str], label: str = "label", epochs: int = 2, lr: float = 1e-3, lr_steps: tuple[int, ...] = (2,), lr_scale: float = 0.1,
    momentum: float = 0.9, decay: float = 1e-4, batch: int = 1024, task_rows: int = 1 << 20, seed: int = 0,
) -> tuple[PairNet, list[float]]:
    """(network, mean loss of each epoch). Rows go in an order of their ids' hash, another one each epoch; null features are 0, rows without a label are left out.

    The rate is scaled by ``lr_scale`` from each epoch of ``lr_steps`` on. A task takes about ``task_rows`` rows.
    """
    ready = pairs.filter(F.col(label).isNotNull()).select("a", "b", F.col(label).cast("long").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    n = ready.count()
    layers = first_layers(len(features), seed)
    velocity = [tuple(np.zeros_like(v) for v in layer) for layer in layers]
    trace: list[float] = []
    if not n:
        return PairNet(list(features), layers), trace
    for epoch in range(epochs):
        rate = lr * lr_scale ** sum(s <= epoch for s in lr_steps)
        order = F.xxhash64(F.lit(seed * 1_000_003 + epoch), "a", "b")
        dealt = ready.withColumn("h", order).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(-(-n // task_rows))))
        met = dealt.repartition(max(1, -(-n // task_rows)), "part").sortWithinPartitions("part", "h", "a", "b").drop("h", "a", "b")
        met = met.select("part", "y", *[f"x{i}" for i in range(len(features))])
        states = met.mapInArrow(_epoch(_flat(layers), _flat(velocity), layers, batch, rate, momentum, decay), "n long, loss double, state array<double>")
        summed = states.select("n", "loss", F.posexplode("state").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v") * F.col("n")).alias("v"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
        rows = sorted(summed.collect(), key=lambda r: r.i)  # a row for each weight and velocity
        state = np.array([r.v / r.n for r in rows])
        layers, velocity = _shaped(state[: len(state) // 2], layers), _shaped(state[len(state) // 2:], layers)
        trace.append(rows[0].loss / rows[0].n)
    return PairNet(list(features), layers), trace


def validate(model: PipelineModel | PairNet, held_out: DataFrame, th: float, label: str = "label") -> DataFrame:
    """Classifier metrics (acc, abs_recall, rel_recall, false_pos, false_neg) of ``model`` at ``th`` on labelled pairs."""
    return pair_metrics(infer(model, held_out).withColumn("label", F.col(label)), th)


def infer(model: PipelineModel | PairNet, pairs: DataFrame) -> DataFrame:
    """``pairs`` with score: the probability of one class."""
    if isinstance(model, PairNet):
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.columns])
        rows = pairs.select(*pairs.columns, x.alias("score"))
        schema = pairs.select(*pairs.columns, F.lit(0.0).alias("score")).schema

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = b.columns[-1].flatten().to_numpy().reshape(b.num_rows, len(model.columns))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(values) if b.num_rows else np.zeros(0))], b.schema.names)

        return rows.mapInArrow(scored, schema)
    scored = model.transform(pairs)
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*pairs.columns, "score")


def select(scored: DataFrame, th: float) -> DataFrame:
    """(a, b, score) above ``th``."""
    return scored.filter(F.col("score") > th).select("a", "b", "score")


def forward(x: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Softmax probability of class 1 of a ReLU network with the given (weights, bias) layers."""
    for weights, bias in layers[:-1]:
        x = relu(affine(x, weights, bias))
    return softmax(affine(x, *layers[-1]))[1]


def save(model: PipelineModel | PairNet, path: str) -> None:
    if isinstance(model, PairNet):
        net = {"columns": model.columns, "layers": [[v.tolist() for v in layer] for layer in model.layers]}
        SparkSession.active().createDataFrame([(json.dumps(net),)], "net string").write.mode("overwrite").text(f"{path}/metadata")
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | PairNet:
    """What ``save`` wrote there."""
    found = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])
    if "layers" not in found:
        return PipelineModel.load(path)
    return PairNet(found["columns"], [tuple(np.array(v) for v in layer) for layer in found["layers"]])

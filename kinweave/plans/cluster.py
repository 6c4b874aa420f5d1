"""Whole clustering runs: estimators for one or several models, the configured pipeline, baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import METRICS
from kinweave.operators import centroids, density, evaluate, labels, mediator, pairs, transform
from kinweave.operators.birch import birch
from kinweave.operators.exemplars import affinity_propagation
from kinweave.operators.hdbscan import hdbscan
from kinweave.operators.linkage import agglomerate
from kinweave.operators.lloyd import lloyd
from kinweave.operators.modes import mean_shift
from kinweave.operators.neighbours import knn
from kinweave.operators.propagate import propagate
from kinweave.operators.rank_order import rank_order_clusters
from kinweave.operators.spectral import spectral
from kinweave.plans.config import Config, log, timed
from kinweave.sources import files
from kinweave.sources.shared import materialize


@dataclass(frozen=True)
class Clusters:
    """Labels of all items (-1 without a cluster), and the pairs they come from."""

    labels: DataFrame
    pairs: DataFrame

    def summary(self) -> DataFrame:
        return evaluate.summary(self.labels)

    def score(self, truth: DataFrame, keep: bool = False) -> DataFrame:
        """Pairwise scores without, or with ``keep`` including, the items left out."""
        both = evaluate.paired(truth, labels.keep_singletons(self.labels) if keep else self.labels)
        return evaluate.pairwise_fscore(both) if keep else evaluate.fscore_removed(both)


def clusters_of(items: DataFrame, chosen: DataFrame, max_sz: int, step: float, max_iter: int) -> Clusters:
    chosen = materialize(chosen, "pairs")
    return Clusters(materialize(labels.label_items(items, propagate(chosen, max_sz, step, max_iter)), "labels"), chosen)


@dataclass(frozen=True)
class GraphClusterer:
    """Clusters of one model's vectors, or with ``fit_many`` of several models that must agree."""

    k: int = 15
    th: float = 0.54
    metric: str = "cosine"
    max_sz: int = 1000
    step: float = 0.05
    max_iter: int = 100
    strategy: str = "exact"

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")

    def lists(self, df: DataFrame, id_col: str, vec: str, within: float = float("inf")) -> DataFrame:
        return materialize(knn(df, self.k, self.metric, id_col, vec, self.strategy, scaled=self.metric != "cosine", within=within), "knn")

    def fit(self, df: DataFrame, id_col: str = "id", vec: str = "embedding") -> Clusters:
        return self.fit_many([df], id_col=id_col, vec=vec)

    def fit_many(self, models: list[DataFrame], accept: int | None = None, id_col: str = "id", vec: str = "embedding") -> Clusters:
        """The first model is the base; a pair needs ``accept`` votes of the others (by default all)."""
        if not models:
            raise ValueError("no models")
        near = 1 - self.th + 1e-9 if self.metric == "cosine" else float("inf")  # farther entries of the base make no pair
        base, *committee = [self.lists(m, id_col, vec, near if m is models[0] else float("inf")) for m in models]
        chosen = pairs.vote_pairs(base, committee, len(committee) if accept is None else accept, self.th)
        items = models[0].select(F.col(id_col).cast("long").alias("id"))
        return clusters_of(items, chosen, self.max_sz, self.step, self.max_iter)


def run_config(
    config: Config, features: dict[str, DataFrame], truth: DataFrame | None = None, train_features: dict[str, DataFrame] | None = None,
    train_truth: DataFrame | None = None, cache: str | None = None,
) -> Clusters:
    """The configured run over (id, embedding) tables by model.

    ``mediator`` learns from ``train_features`` with ``train_truth``;
    ``groundtruth`` links pairs of one class of ``truth``. ``cache`` names a
    folder for this data: neighbour lists, vote pairs, pair sets and the trained
    mediator found there under the hash of their settings are taken as they
    are, others are made and kept (``force_retrain`` trains again).
    """
    names = [config.base, *config.committee]
    spark = features[config.base].sparkSession

    def kept(name: str, key: str, make) -> DataFrame:
        with timed(name):
            return materialize(make(), name) if cache is None else files.cached(spark, cache, f"{name}-{key}", make)

    def lists_of(tables: dict[str, DataFrame], phase: str) -> dict[str, DataFrame]:
        def of(m: str) -> DataFrame:
            key = config.key("k", "metric", "knn_strategy", model=m, phase=phase)
            return kept(f"knn-{m}", key, lambda: knn(tables[m], config.k, config.metric, strategy=config.knn_strategy, scaled=config.metric != "cosine"))

        return {m: of(m) for m in names}

    lists = lists_of(features, "apply")
    base, committee = lists[config.base], {m: lists[m] for m in config.committee}
    graph = ("base", "committee", "k", "metric", "knn_strategy")
    if config.strategy == "vote":
        accept = len(committee) if config.accept is None else config.accept
        chosen = kept("vote-pairs", config.key(*graph, "accept", "th"), lambda: pairs.vote_pairs(base, list(committee.values()), accept, config.th))
    elif config.strategy == "groundtruth":
        if truth is None:
            raise ValueError("groundtruth needs the true labels")
        chosen = pairs.ground_truth(pairs.labelled(pairs.all_pairs(base), truth))
    elif config.strategy == "mediator":
        columns = pairs.feature_columns(config.base, list(config.committee), config.inputs)

        def pair_set(tables: dict[str, DataFrame], found: dict[str, DataFrame], phase: str, labelled: DataFrame | None) -> DataFrame:
            ordered = {m: tables[m] for m in names}
            make = lambda: pairs.pair_set(found[config.base], {m: found[m] for m in config.committee}, ordered, config.base, labelled, config.inputs)
            return kept(f"pair-set-{phase}", config.key(*graph, "inputs"), make)

        learnt = ("learning", "epochs", "lr") if config.learning == "sgd" else ()
        path = cache and f"{cache.rstrip('/')}/mediator-{config.key(*graph, 'inputs', *learnt)}"
        if path and not config.force_retrain and files.exists(spark, f"{path}/metadata"):
            log.info("mediator found: %s", path)
            model = mediator.load(path)
        else:
            if train_features is None or train_truth is None:
                raise ValueError("mediator needs a labelled set")
            train_set = pair_set(train_features, lists_of(train_features, "train"), "train", train_truth)
            with timed("mediator"):
                if config.learning == "sgd":
                    out = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) < int(config.validate * (1 << 20))
                    model, trace = mediator.train_sgd(train_set.filter(~out), columns, epochs=config.epochs, lr=config.lr)
                    log.info("mediator, loss by epoch: %s", trace)
                    if config.validate:
                        log.info("mediator: %s", mediator.validate(model, train_set.filter(out), config.th).first().asDict())
                elif config.validate:
                    out = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) < int(config.validate * (1 << 20))
                    model, history = mediator.train_rounds(train_set.filter(~out), train_set.filter(out), columns, config.th)
                    for i, metrics in enumerate(history):
                        log.info("mediator, round %d: %s", i, metrics)
                else:
                    model = mediator.train(train_set, columns)
            if path:
                mediator.save(model, path)
        chosen = mediator.select(mediator.infer(model, pair_set(features, lists, "apply", None)), config.th)
    else:
        raise ValueError(f"unknown strategy {config.strategy!r}")
    with timed("propagation"):
        return clusters_of(features[config.base].select("id"), chosen, config.max_sz, config.step, config.max_iter)


def _numbered(found: DataFrame) -> DataFrame:
    """Labels of (id, comp), null comps as -1."""
    return labels.label_items(found.select("id"), found.filter("comp is not null").select("id", "comp"))


def baseline(method: str, df: DataFrame, id_col: str = "id", vec: str = "embedding", unit: bool = True, **o) -> DataFrame:
    """(id, label) by a baseline method, vectors brought to unit length first."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("embedding"))
    df = materialize(transform.unit_rows(df), "unit-rows") if unit else df  # methods read them more than once
    clusters = o.get("clusters", 8)
    lists = lambda: materialize(knn(df, o.get("k", 15)), "knn")

    def fast_hac() -> DataFrame:
        """Linkage over all pairs, cut at a height."""
        cut, linkage = o.get("cut", 0.7), o.get("linkage", "single")
        return _numbered(density.single_linkage(df, cut) if linkage == "single" else agglomerate(df, method=linkage, k=None, height=cut))

    methods = {
        "kmeans": lambda: centroids.kmeans(df, clusters)[0],
        "mini_batch_kmeans": lambda: centroids.minibatch_kmeans(df, clusters),
        "spectral": lambda: spectral(lists(), clusters),
        "hac": lambda: _numbered(agglomerate(df, clusters, o.get("linkage", "ward"), o.get("k", 30), o.get("metric", "l2"))),
        "birch": lambda: _numbered(birch(df, clusters, o.get("threshold", 0.5))),
        "lloyd": lambda: lloyd(df, clusters)[0].select("id", "label"),
        "bisecting": lambda: centroids.bisecting(df, clusters),
        "gmm": lambda: centroids.gaussian_mixture(df, clusters),
        "fast_hac": fast_hac,
        "dbscan": lambda: _numbered(density.dbscan(df, o.get("eps", 0.75), o.get("min_samples", 10))),
        "knn_dbscan": lambda: _numbered(density.knn_dbscan(lists(), o.get("eps", 0.75), o.get("min_samples", 10), o.get("least", 0.7))),
        "hdbscan": lambda: _numbered(hdbscan(df, o.get("min_size", 10), o.get("min_samples"))),
        "aro": lambda: _numbered(rank_order_clusters(lists(), o.get("th", 2.0))),
        "affinity_propagation": lambda: _numbered(affinity_propagation(df, o.get("damping", 0.5), o.get("preference"), o.get("k", 30))),
        "mean_shift": lambda: mean_shift(df, o.get("bandwidth"), o.get("quantile", 0.3)),
    }
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(methods)}")
    return methods[method]()


def whitened_kmeans(df: DataFrame, clusters: int, dims: int = 256, id_col: str = "id", vec: str = "embedding", max_iter: int = 20) -> tuple[DataFrame, float]:
    """PCA whitening, then k-means: ((id, label), summed squared distance)."""
    white = transform.whiten(df, *transform.fit_whitening(df, vec, dims), vec)
    return centroids.kmeans(white, clusters, id_col, vec, max_iter=max_iter)

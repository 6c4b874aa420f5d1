"""Clusterings around centres from spark.ml, and mini-batch k-means, whose centres follow successive samples."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import doubles
from kinweave.operators.neighbours import _distances, _matrix, _plain

BATCH_ROWS = 10_000


def _rows(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), array_to_vector(doubles(vec)).alias("features"))


def _labels(out: DataFrame) -> DataFrame:
    return out.select("id", F.col("prediction").cast("int").alias("label"))


def kmeans(df: DataFrame, clusters: int, id_col: str = "id", vec: str = "embedding", seed: int = 0, max_iter: int = 20) -> tuple[DataFrame, float]:
    """((id, label), summed squared distance)."""
    rows = _rows(df, id_col, vec)
    model = KMeans(k=clusters, seed=seed, maxIter=max_iter).fit(rows)
    return _labels(model.transform(rows)), float(model.summary.trainingCost)


def bisecting(df: DataFrame, clusters: int, id_col: str = "id", vec: str = "embedding", seed: int = 0) -> DataFrame:
    rows = _rows(df, id_col, vec)
    return _labels(BisectingKMeans(k=clusters, seed=seed).fit(rows).transform(rows))


def gaussian_mixture(df: DataFrame, clusters: int, id_col: str = "id", vec: str = "embedding", seed: int = 0) -> DataFrame:
    rows = _rows(df, id_col, vec)
    return _labels(GaussianMixture(k=clusters, seed=seed).fit(rows).transform(rows))


def minibatch_kmeans(df: DataFrame, clusters: int, id_col: str = "id", vec: str = "embedding", batch_rows: int = BATCH_ROWS, steps: int = 20, seed: int = 0) -> DataFrame:
    """Centres move towards successive batches of about ``batch_rows`` rows, then every row is assigned."""
    rows = _plain(df, id_col, vec, "l2")
    n = rows.count()
    share = min(1.0, batch_rows / max(n, 1))

    def batch(k: int) -> np.ndarray:
        part = F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
        return _matrix(rows.filter(part).orderBy("id").select("id", "v").toArrow().column(1).combine_chunks())

    first = batch(0)
    centre = first[np.random.default_rng(seed).choice(len(first), min(clusters, len(first)), replace=False)]
    seen = np.zeros(len(centre))
    for k in range(1, steps + 1):
        x = batch(k)
        near = _distances(x, centre, "l2").argmin(1)
        size, total = np.bincount(near, minlength=len(centre)), np.zeros_like(centre)
        np.add.at(total, near, x)
        seen += size
        moved = size > 0
        centre[moved] += (total[moved] - size[moved, None] * centre[moved]) / seen[moved, None]

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            near = _distances(_matrix(b.column(1)), centre, "l2").argmin(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32())], ["id", "label"])

    return rows.mapInArrow(assign, "id long, label int")

"""Birch: rows summed up in clustering features, which are clustered in their place.

A feature has the number, sum and squared length of its rows. Tasks put every row
into the nearest feature if its radius stays within the threshold, else into a
new one; a task that holds more than ``MOST_FEATURES`` doubles its threshold and
puts its features into one another again, so memory stays bounded. Features are
rows of a few tasks again until they no longer halve, are clustered by Ward's
linkage with their weights, and every row takes the cluster of the nearest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import linkage, neighbours
from kinweave.sources.shared import materialize

MOST_FEATURES = 5000
_FEATURES = "n double, s array<double>, q double"


class Features:
    """Clustering features of one task: numbers, sums and squared lengths."""

    def __init__(self, width: int, threshold: float, most: int = MOST_FEATURES):
        self.threshold, self.most, self.size = threshold, most, 0
        self.n, self.s, self.q = np.zeros(64), np.zeros((64, width)), np.zeros(64)

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """Put features (or rows: n of 1) into the nearest within the threshold, one after another."""
        for i in range(len(n)):
            self._put(n[i], s[i], q[i])
            if self.size > self.most:
                self._shrink()

    def _put(self, n: float, s: np.ndarray, q: float) -> None:
        if self.size:
            held = slice(self.size)
            centre = self.s[held] / self.n[held, None]
            at = int(((centre - s / n) ** 2).sum(1).argmin())
            total, both = self.n[at] + n, self.s[at] + s
            if (self.q[at] + q) / total - ((both / total) ** 2).sum() <= self.threshold**2:
                self.n[at], self.s[at], self.q[at] = total, both, self.q[at] + q
                return
        if self.size == len(self.n):
            self.n, self.s, self.q = (np.concatenate([a, np.zeros_like(a)]) for a in (self.n, self.s, self.q))
        self.n[self.size], self.s[self.size], self.q[self.size] = n, s, q
        self.size += 1

    def _shrink(self) -> None:
        n, s, q = self.n[: self.size].copy(), self.s[: self.size].copy(), self.q[: self.size].copy()
        while self.size > self.most:
            self.threshold, self.size = max(2 * self.threshold, 1e-6), 0
            for i in range(len(n)):
                self._put(n[i], s[i], q[i])


def _batches(threshold: float, most: int, rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                x = neighbours._matrix(b.column(1))
                held = held or Features(x.shape[1], threshold, most)
                if rows:
                    held.add(np.ones(len(x)), x, (x * x).sum(1))
                else:
                    held.add(b.column(0).to_numpy(), x, b.column(2).to_numpy())
        if held is not None:
            own = slice(held.size)
            yield pa.RecordBatch.from_arrays([pa.array(held.n[own]), pa.array(held.s[own].tolist(), pa.list_(pa.float64())), pa.array(held.q[own])], ["n", "s", "q"])

    return run


def features(df: DataFrame, threshold: float = 0.5, id_col: str = "id", vec: str = "embedding", most: int = MOST_FEATURES) -> DataFrame:
    """(n, s, q) of all rows with a vector; their sums are those of the rows."""
    rows = neighbours._plain(df, id_col, vec, "l2").select("id", "v")
    found = materialize(rows.mapInArrow(_batches(threshold, most, True), _FEATURES), "features")
    count = found.count()
    parts = max(1, found.rdd.getNumPartitions())
    while parts > 1:  # tasks meet in fewer ones while that makes them fewer
        parts = -(-parts // 8)
        fewer = materialize(found.repartition(parts).mapInArrow(_batches(threshold, most, False), _FEATURES), "features")
        now = fewer.count()
        found, halved, count = fewer, now <= count / 2, now
        if not halved:
            break
    return found


def birch(df: DataFrame, clusters: int | None = 3, threshold: float = 0.5, id_col: str = "id", vec: str = "embedding", most: int = MOST_FEATURES) -> DataFrame:
    """(id, comp): rows by the cluster of the nearest feature (with ``clusters`` None, by the feature); comp is the smallest row."""
    rows = materialize(neighbours._plain(df, id_col, vec, "l2"), "birch-rows")
    held = features(rows, threshold, "id", "v", most).select(F.monotonically_increasing_id().alias("id"), F.transform("s", lambda x: x / F.col("n")).alias("v"), "n")
    held = materialize(held, "features")
    lists, _ = neighbours._compared(held.select("id", "v"), lambda i, x, j, y: neighbours._nearest(i, x, j, y, 1, "l2"), None, neighbours.BROADCAST_BYTES, rows)
    near = materialize(lists.groupBy("id").agg(F.min(F.struct("dist", "nbr")).alias("m")).select("id", F.col("m.nbr").alias("leaf")), "nearest")
    if clusters is not None:
        label = linkage.agglomerate(held, clusters, "ward", None, vec="v", weight="n")
        near = near.join(label.select(F.col("id").alias("leaf"), "comp"), "leaf").select("id", F.col("comp").alias("leaf"))
    name = near.groupBy("leaf").agg(F.min("id").alias("comp"))
    return near.join(name, "leaf").select("id", "comp")

"""Exact minimum spanning trees of mutual reachability, by rounds of nearest rows outside one's own part.

The mutual reachability of two rows is the largest of their distance and their
core distances (the distance to the ``samples``-th nearest row, itself included).
The lists that tell the core distances are longer by ``LISTED`` rows and serve the
first rounds too: a row that is not listed is farther than the last that is, and
its mutual reachability is no less than its distance. A round lets every part but
the largest take its least edge to another one. Rows whose lists are used up, and
which could still beat the least edge known to their part, look for the ``LISTED``
nearest outside it among all rows; those of the largest part, most rows soon, never do.

At most ``DENSE_ROWS`` rows are joined by one task over their distance matrix.

Equal vectors are one row in the search; the others hang on it at their core
distance, which no edge of theirs can undercut. Pairs are screened by coarse
numbers and measured by a formula that is the same from both sides, so that parts
agree on the order of edges (weight, smaller id, larger id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.forest import min_roots
from kinweave.operators import neighbours
from kinweave.operators.components import connected_components
from kinweave.sources.shared import discard, materialize

LISTED = 16
#: Rows whose distance matrix one task may hold.
DENSE_ROWS = 2048
_EDGES = "a long, b long, w double"


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of a minimum spanning forest's edges, in order of (w, a, b).

    Every component takes its first edge to another one until none is left.
    """
    order = np.lexsort((b, a, w))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v, place = ends[: len(order)], ends[len(order):], np.arange(len(order))
    parent, kept = np.arange(len(nodes)), np.zeros(len(order), dtype=bool)
    while len(place):
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, u, place)
        np.minimum.at(best, v, place)
        taken = np.isin(place, best)
        kept[place[taken]] = True
        linked, roots = min_roots(u[taken], v[taken])
        parent[linked] = roots
        u, v = parent[u], parent[v]
        open_ = u != v
        u, v, place = u[open_], v[open_], place[open_]
    return order[kept]


def _apart(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x to the same rows of y, equal when x and y change places."""
    if metric == "l2":
        return np.sqrt(((x - y) ** 2).sum(1))
    if metric == "l1":
        return np.abs(x - y).sum(1)
    if metric == "linf":
        return np.abs(x - y).max(1)
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    cos = (unit(x) * unit(y)).sum(1)
    return 1 - cos if metric == "cosine" else np.arccos(np.clip(cos, -1, 1))


def _part(m: np.ndarray) -> np.ndarray:
    return (m[:, -2].astype(np.int64) << 32) | m[:, -1].astype(np.int64)


class _Outside(neighbours._Lists):
    """The ``k`` nearest of each row by mutual reachability, ties to the smaller id, among rows of other parts.

    Rows are a vector, its core distance and the halves of its part.
    """

    def __init__(self, x: np.ndarray, k: int, metric: str) -> None:
        super().__init__(np.ascontiguousarray(x[:, :-3]), k, metric)
        self.core, self.part = x[:, -3], _part(x)

    def add(self, base_ids: np.ndarray, y: np.ndarray) -> None:
        core, part, v = y[:, -3], _part(y), self.placed(np.ascontiguousarray(y[:, :-3]))
        at = 0
        while at < len(base_ids):
            lot = min(neighbours.TILE_ROWS, max(neighbours.FIRST_ROWS, self.k, self.seen))
            tile, cut = slice(at, at + lot), self.value[:, -1]
            near = neighbours._near(self.x, v[tile], cut, self.metric)
            near &= self.part[:, None] != part[tile]
            near &= core[tile] <= cut[:, None]
            row, col = neighbours._places(near)
            for some in range(0, len(row), neighbours.PAIR_ROWS):
                r, c = row[some:some + neighbours.PAIR_ROWS], at + col[some:some + neighbours.PAIR_ROWS]
                d = neighbours._pair_distances(self.x[r], v[c], self.metric)
                self._enter(r, base_ids[c], np.maximum(np.maximum(d, self.core[r]), core[c]))
            at += lot
            self.seen += lot


def _dense_tree(batches: Iterator[pd.DataFrame], metric: str) -> Iterator[pd.DataFrame]:
    """The tree of a few rows (id, v, core), grown from one row by the nearest other."""
    held = list(batches)
    if sum(map(len, held)) < 2:
        return
    rows = pd.concat(held).sort_values("id")
    ids, x, core = rows.id.to_numpy(), np.stack(rows.v.to_numpy()), rows.core.to_numpy()
    near, link, left = np.full(len(ids), np.inf), np.zeros(len(ids), dtype=np.int64), np.arange(1, len(ids))
    at, out = 0, []
    while len(left):
        w = np.maximum(np.maximum(_apart(np.broadcast_to(x[at], (len(left), x.shape[1])), x[left], metric), core[left]), core[at])
        closer = w < near[left]
        near[left[closer]], link[left[closer]] = w[closer], at
        best = int(near[left].argmin())
        at = int(left[best])
        out.append((min(ids[at], ids[link[at]]), max(ids[at], ids[link[at]]), near[at]))
        left = np.delete(left, best)
    yield pd.DataFrame(out, columns=["a", "b", "w"])


def core_distances(lists: DataFrame, copies: DataFrame, samples: int) -> DataFrame:
    """(id, core): the distance to the ``samples``-th nearest row, itself included (the farthest where there are fewer).

    ``lists`` are of distinct vectors, which stand for ``n`` rows each in ``copies``.
    """
    nearer = Window.partitionBy("id").orderBy("rank")
    met = lists.filter(F.col("rank") <= samples).join(copies.select(F.col("id").alias("nbr"), "n"), "nbr")
    met = met.withColumn("before", F.sum("n").over(nearer) - F.col("n"))
    return met.filter(F.col("before") < samples).groupBy("id").agg(F.max("dist").alias("core"))


def reachability_tree(df: DataFrame, samples: int, metric: str = "l2", id_col: str = "id", vec: str = "embedding", listed: int = LISTED, dense_rows: int = DENSE_ROWS, block_rows: int | None = None, broadcast_bytes: int = neighbours.BROADCAST_BYTES) -> DataFrame:
    """(a, b, w): a minimum spanning tree of the mutual reachability of all rows with a vector."""
    blocks = {"block_rows": block_rows, "broadcast_bytes": broadcast_bytes}
    plain = neighbours._plain(df, id_col, vec, metric).groupBy("id").agg(F.min("v").alias("v"))
    plain = plain.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    leaves = plain.groupBy("v").agg(F.min("id").alias("leaf"), F.count(F.lit(1)).alias("n"))
    held = materialize(plain.join(leaves, "v").select("id", "leaf", "n", "v"), "reachability-rows")
    rows = held.filter("id = leaf").select("id", "v")
    lists = materialize(neighbours.knn(rows, samples + listed, metric, "id", "v", **blocks), "nearest")
    core = materialize(core_distances(lists, held.filter("id = leaf"), samples), "core")
    rows = rows.join(core, "id")
    tree = [held.filter("id <> leaf").join(core.withColumnRenamed("id", "leaf"), "leaf").select(F.col("leaf").alias("a"), F.col("id").alias("b"), F.col("core").alias("w"))]
    parts = core.count()
    if parts <= dense_rows:
        return tree[0].unionByName(rows.coalesce(1).mapInPandas(lambda batches: _dense_tree(batches, metric), _EDGES))
    state = materialize(rows.select("id", F.col("id").alias("part")), "parts")
    near = lists.filter("id <> nbr").join(core, "id").join(core.select(F.col("id").alias("nbr"), F.col("core").alias("other")), "nbr").select("id", "nbr", F.greatest("dist", "core", "other").alias("w"))
    # of rows that have searched, an entry that is left is the nearest; of others, if it is below the floor
    floors = lists.groupBy("id").agg(F.when(F.count(F.lit(1)) == samples + listed, F.max("dist")).otherwise(np.inf).alias("floor")).withColumn("searched", F.lit(False))
    largest = None
    while parts > 1:
        of = lambda end, name: state.select(F.col("id").alias(end), F.col("part").alias(name))
        near = materialize(near.select("id", "nbr", "w").join(of("id", "p"), "id").join(of("nbr", "q"), "nbr").filter("p <> q").select("id", "nbr", "w", "p"), "outside")
        best = near.groupBy("id").agg(F.min("w").alias("least"))
        known = near.groupBy("p").agg(F.min("w").alias("top"))
        choosing = state if largest is None else state.filter(F.col("part") != largest)
        asking = choosing.join(floors, "id").join(best, "id", "left").withColumnRenamed("part", "p").join(known, "p", "left")
        asking = materialize(asking.filter("(least is null or (not searched and least >= floor)) and (top is null or floor <= top)").select("id"), "asking")
        if not asking.isEmpty():
            key = F.array(F.shiftright("part", 32).cast("double"), F.col("part").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))
            marked = materialize(rows.join(state, "id").select("id", F.concat("v", F.array("core"), key).alias("v")), "marked")
            found = neighbours._searched(marked, lambda x: _Outside(x, listed, metric), block_rows, broadcast_bytes, marked.join(asking, "id", "left_semi"))
            fresh = found.filter("rank = 0").select("id", F.col("dist").alias("floor"), F.lit(True).alias("searched"))
            fresh_near = found.filter("rank > 0").select("id", "nbr", F.col("dist").alias("w"))
            near = materialize(near.select("id", "nbr", "w").join(asking, "id", "left_anti").unionByName(fresh_near), "outside")
            floors = materialize(floors.join(asking, "id", "left_anti").unionByName(fresh), "floors")
            discard(marked)
        least = near.select("id", "nbr", "w").join(choosing.withColumnRenamed("part", "p"), "id").groupBy("p").agg(F.min(F.struct("w", F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"))).alias("m"))
        chosen = materialize(least.select("m.a", "m.b", "m.w").distinct(), "tree")
        ends = chosen.join(of("a", "p"), "a").join(of("b", "q"), "b")
        merged = materialize(connected_components(ends.select("p", "q"), "p", "q"), "merged")
        # the largest part may be the nearest of none
        state = materialize(state.join(merged.select(F.col("id").alias("part"), "comp"), "part", "left").select("id", F.coalesce("comp", "part").alias("part")), "parts")
        of_parts = state.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("top")).first()
        now, largest = of_parts.parts, of_parts.top.part
        if chosen.count() > parts - now:  # ties within rounding closed a circle
            chosen = materialize(_without_circles(ends), "tree")
        tree.append(chosen)
        parts = now
    out = tree[0]
    for part in tree[1:]:
        out = out.unionByName(part)
    return out


def _without_circles(ends: DataFrame) -> DataFrame:
    """Edges (a, b, w) that form a forest over the parts (p, q) they join; each is the least of a part, so a round has at most one a part."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(batches))
        yield e.iloc[spanning_forest(e.p.to_numpy(), e.q.to_numpy(), e.w.to_numpy())][["a", "b", "w"]]

    return ends.select("a", "b", "w", "p", "q").coalesce(1).mapInPandas(one, _EDGES)

"""Approximate neighbour lists without a pass over all pairs: refined lists, randomised kd-trees.

``descent`` starts from lists of rows that share hash buckets along random
directions and improves them in rounds: every row gathers the vectors of its
neighbours and of a sample of the rows that list it, compares all of them with
one another in one task, and hands each the others that beat the worst entry of
its list. Pairs that both took part before are left out. When few entries change,
a sample of rows is searched exactly; while the lists have less than ``RECALL`` of
what it finds, they get longer by half and go on, since how much settled lists know
depends on their length.

``kd_forest`` fits a few trees on a bounded sample: every node splits at the mean
of a coordinate drawn from those that vary most. Every row lies in one leaf of
each tree and is searched for in the leaves of least bound, all trees together,
as many as its budget says. Where ``budget`` is not given, it is the least with
which a sample of rows finds ``RECALL`` of the neighbours that its exact search has.

Vectors of cosine and angular lists are taken to unit length for placing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators import neighbours
from kinweave.sources.shared import discard, materialize

SAMPLE_ROWS = 20_000
QUERY_ROWS = 256
RECALL = 0.95  # of the sampled queries, so that all rows are above 0.9
LEAF_ROWS = 512
TREES = 4


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if metric in ("cosine", "angular") else x


def _sample(rows: DataFrame, n: int, most: int = SAMPLE_ROWS) -> pa.Table:
    """About ``most`` rows by hash of their ids, at most twice as many."""
    share = int(min(1.0, most / n) * (1 << 20)) + 1
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).limit(2 * most).orderBy("id").toArrow()


# refined lists


def _batched(x: np.ndarray, metric: str) -> np.ndarray:
    """All distances inside each group of vectors (group, member, coordinate)."""
    if metric in ("cosine", "angular"):
        u = x / np.sqrt((x * x).sum(2, keepdims=True))
        cos = u @ u.transpose(0, 2, 1)
        return 1 - cos if metric == "cosine" else np.arccos(np.clip(cos, -1, 1))
    if metric == "l2":
        own = (x * x).sum(2)
        return np.sqrt(np.maximum(own[:, :, None] + own[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0))
    return np.stack([neighbours._distances(g, g, metric) for g in x]).astype(np.float64)


def _meetings(metric: str, limit: int = 1 << 22):
    """(id, nbr, dist) of members that would enter one another's lists, from rows (ids, worst, fresh, vs) of a pivot each."""

    def met(ids, worst, fresh, x) -> pa.RecordBatch:
        d = _batched(x, metric)
        other = ids[:, :, None] != ids[:, None, :]
        new = fresh[:, :, None] | fresh[:, None, :]
        g, i, j = np.nonzero(other & new & (d < worst[:, :, None]))
        return pa.RecordBatch.from_arrays([pa.array(ids[g, i]), pa.array(ids[g, j]), pa.array(d[g, i, j])], ["id", "nbr", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(batch.column(0).offsets.to_numpy())
            for m in np.unique(size):
                rows = np.flatnonzero(size == m)
                flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.take(pa.array(rows)).columns]
                width = len(flat[3]) // max(1, len(flat[0]))
                step = max(1, limit // (int(m) * max(int(m), width)))
                for at in range(0, len(rows), step):
                    lot = slice(at * m, (at + step) * m)
                    part = [f[lot].reshape(-1, m) for f in flat[:3]]
                    yield met(*part, flat[3][at * m * width:(at + step) * m * width].reshape(len(part[0]), m, width))

    return run


def _buckets(rows: DataFrame, n: int, width: int, metric: str, list_rows: int, seed: int) -> DataFrame:
    """(bucket, id, v): rows that lie together along random directions, about ``list_rows`` in a bucket."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / list_rows)))))
    planes = np.random.default_rng(seed).normal(size=(width, bits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = _placed(neighbours._matrix(batch.column(1)), metric) @ planes > 0
                yield pa.RecordBatch.from_arrays([pa.array(side @ (1 << np.arange(bits)).astype(np.int64) if bits else np.zeros(batch.num_rows, np.int64)), *batch.columns], ["bucket", "id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(place, f"bucket long, id long, v {kind}")


def descent(rows: DataFrame, k: int, metric: str, listed: int | None = None, sample: int | None = None, rounds: int = 16, change: float = 0.002, seed: int = 0) -> DataFrame:
    """(id, rank, nbr, dist) of rows (id, v): lists of ``listed`` entries (default 2 k + 10) refined until at most ``change`` of them move in a round,
    or for ``rounds``; then longer ones, until a sample has ``RECALL`` of its neighbours.

    ``sample`` (default ``listed``) bounds how many of the rows that list it a row
    gathers. A row that stands in for itself is in its own list at rank 1.
    """
    listed, spark = listed or 2 * k + 10, rows.sparkSession
    sample = sample or listed
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if size.n == 0:
        return rows.select("id", F.lit(0).alias("rank"), F.col("id").alias("nbr"), F.lit(0.0).alias("dist"))
    rows = materialize(rows, "descent-rows")
    near = Window.partitionBy("id").orderBy("dist", "nbr")
    shared = _buckets(rows, size.n, size.width, metric, max(listed, 64), seed)
    # members of a bucket in groups of 2 listed, so that a large bucket is many tasks' work
    counts = materialize(shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("parts", F.ceil(F.col("c") / (2 * listed))), "buckets")
    dealt = shared.join(counts, "bucket").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")))

    def gathered(members: DataFrame, *key: str) -> DataFrame:
        m = members.groupBy(*key).agg(F.collect_list(F.struct("id", "worst", "fresh", "v")).alias("m"))
        return m.select("m.id", "m.worst", "m.fresh", F.flatten("m.v").alias("vs"))

    first = gathered(dealt.withColumns({"worst": F.lit(float("inf")), "fresh": F.lit(True)}), "bucket", "part").mapInArrow(_meetings(metric), "id long, nbr long, dist double")
    few = max(2, listed // 2)  # strangers for rows whose bucket is small
    ring = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("turn")).withColumn("slot", F.pmod(F.xxhash64("id", "turn"), F.lit(max(1, size.n // 8)).cast("long")))
    some = Window.partitionBy("slot", "turn").orderBy(F.xxhash64("id"))
    strangers = ring.withColumn("nbr", F.lag("id").over(some)).filter("nbr is not null and nbr <> id").select("id", "nbr").distinct()
    own = rows.select("id", "v").join(strangers, "id").withColumnRenamed("v", "x").join(rows.select(F.col("id").alias("nbr"), F.col("v").alias("y")), "nbr")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = neighbours._matrix(b.column(2)), neighbours._matrix(b.column(3))
                d = np.concatenate([_batched(np.stack([x[i:i + 4096], y[i:i + 4096]], axis=1), metric)[:, 0, 1] for i in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["id", "nbr", "dist"])

    start = first.unionByName(own.select("id", "nbr", "x", "y").mapInArrow(measured, "id long, nbr long, dist double")).distinct()
    lists = materialize(start.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= listed).select("id", "nbr", "dist", F.lit(True).alias("fresh")), "descent")
    settled, last = listed, rounds - 1
    for step in count():
        held = F.count(F.lit(1))
        # distances grow ever more slowly with rank, so half as many more lie within what the upper half of a full list spans
        further = F.when(held >= settled, 2 * F.max("dist") - F.median("dist")).otherwise(float("inf"))
        worst = lists.groupBy("id").agg(F.when(held >= listed, F.max("dist")).otherwise(further).alias("worst"))
        members = materialize(rows.join(worst, "id", "left").fillna(float("inf"), ["worst"]), "descent-members")
        pick = Window.partitionBy("pivot", "fresh").orderBy(F.xxhash64("id", F.lit(seed + step)))
        back = lists.select(F.col("nbr").alias("pivot"), "id", "fresh").withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= sample).drop("r")
        links = lists.select(F.col("id").alias("pivot"), F.col("nbr").alias("id"), "fresh").unionByName(back).groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
        met = gathered(links.join(members, "id"), "pivot").mapInArrow(_meetings(metric), "id long, nbr long, dist double")
        better = met.groupBy("id", "nbr").agg(F.min("dist").alias("dist"), F.lit(True).alias("fresh"))
        both = lists.select("id", "nbr", "dist", F.lit(False).alias("fresh")).unionByName(better).groupBy("id", "nbr").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
        before = lists
        lists = materialize(both.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= listed).select("id", "nbr", "dist", "fresh"), "descent")
        discard(before, members)
        moved = lists.filter("fresh").count()
        if moved <= change * size.n * min(listed, size.n) or step >= last:
            ranked = lists.select("id", "nbr", "dist").unionByName(rows.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist")))
            ranked = ranked.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("id", "rank", "nbr", "dist")
            if listed >= size.n - 1 or _share(rows, ranked, size.n, k, metric) >= RECALL:
                return ranked
            longer = min(size.n - 1, listed + max(1, listed // 2))
            sample, settled, listed, last = sample + longer - listed, listed, longer, step + rounds
            before, lists = lists, materialize(lists.withColumn("fresh", F.lit(True)), "descent")  # all meet again, for more places
            discard(before)


def _share(rows: DataFrame, found: DataFrame, n: int, k: int, metric: str) -> float:
    """The share of the exact neighbours of a sample of rows that is in the lists ``found``."""
    asked = _sample(rows, n, min(n, QUERY_ROWS))
    ids, queries = asked.column(0).combine_chunks().to_numpy(), neighbours._matrix(asked.column(1).combine_chunks())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbours._Lists(queries, k, metric)
        for batch in batches:
            if batch.num_rows:
                lists.add(batch.column(0).to_numpy(), lists.placed(neighbours._matrix(batch.column(1))))
        row, rank, nbr, dist = lists.found()
        yield neighbours._list_batch((ids[row], rank, nbr, dist))

    want = materialize(neighbours._cut(rows.mapInArrow(exact, neighbours._LIST), k).select("id", "nbr"), "sample-lists")
    both = want.join(found.select("id", "nbr"), ["id", "nbr"], "left_semi").count(), want.count()
    discard(want)
    return both[0] / max(1, both[1])


# randomised kd-trees


def grow(sample: np.ndarray, depth: int, seed: int, choices: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, value) of the splits of a complete tree of ``depth``, nodes by level; a coordinate is drawn from the ``choices`` that vary most."""
    r = np.random.default_rng(seed)
    axis, value = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    held = [np.arange(len(sample))]
    for node in range(len(axis)):
        own = held[node]
        x = sample[own] if len(own) else sample
        widest = np.argsort(-x.var(0), kind="stable")[:choices]
        axis[node] = widest[r.integers(len(widest))]
        column = x[:, axis[node]]
        value[node] = column.mean()
        right = sample[own, axis[node]] > value[node] if len(own) else np.zeros(0, dtype=bool)
        held += [own[~right], own[right]]
    return axis, value


def leaf_bounds(x: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each row and leaf, the sum of squared distances to the splits that part them; 0 for the row's own leaf."""
    bound = np.zeros((len(x), 1))
    first = 0
    while first < len(axis):
        nodes = slice(first, 2 * first + 1)
        off = x[:, axis[nodes]] - value[nodes]
        cost, right = off * off, off > 0
        bound = np.stack([bound + np.where(right, cost, 0), bound + np.where(right, 0, cost)], axis=2).reshape(len(x), -1)
        first = 2 * first + 1
    return bound


def kd_forest(rows: DataFrame, k: int, metric: str, trees: int = TREES, leaf_rows: int = LEAF_ROWS, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(id, rank, nbr, dist) of rows (id, v) from the ``budget`` leaves nearest to each row, over all trees."""
    n = rows.count()
    if n == 0:
        return rows.select("id", F.lit(0).alias("rank"), F.col("id").alias("nbr"), F.lit(0.0).alias("dist"))
    depth = min(12, max(0, int(np.ceil(np.log2(n / leaf_rows)))))
    taken = _sample(rows, n)
    sample = neighbours._matrix(taken.column(1).combine_chunks())
    fitted = [grow(_placed(sample, metric), depth, seed + t) for t in range(trees)]
    leaves = 1 << depth

    def bounds(x: np.ndarray) -> np.ndarray:
        return np.concatenate([leaf_bounds(_placed(x, metric), *f) for f in fitted], axis=1)

    if budget is None:
        some = np.sort(np.random.default_rng(seed).choice(len(sample), min(QUERY_ROWS, len(sample)), replace=False))
        budget = _enough_leaves(rows, taken.take(pa.array(some)).combine_chunks(), bounds, leaves, trees, k, metric)

    def own(x: np.ndarray) -> np.ndarray:
        return bounds(x).reshape(len(x), trees, leaves).argmin(2) + np.arange(trees) * leaves

    def asked(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), trees * leaves), dtype=bool)
        np.put_along_axis(out, np.argsort(bounds(x), axis=1, kind="stable")[:, :budget], True, axis=1)
        return out

    return neighbours.cell_lists(rows, trees, trees * leaves, own, asked, k, metric)


def _enough_leaves(rows: DataFrame, asked: pa.Table, bounds, leaves: int, trees: int, k: int, metric: str) -> int:
    """The least budget with which the ``asked`` rows find ``RECALL`` of their exact neighbours."""
    ids, queries = asked.column(0).combine_chunks().to_numpy(), neighbours._matrix(asked.column(1).combine_chunks())
    place = np.argsort(np.argsort(bounds(queries), axis=1, kind="stable"), axis=1)  # of each leaf in each query's order

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None  # of what the task has seen
        for batch in batches:
            for at in range(0, batch.num_rows, neighbours.TILE_ROWS):
                part = batch.slice(at, neighbours.TILE_ROWS)
                base, x = part.column(0).to_numpy(), neighbours._matrix(part.column(1))
                order = np.argsort(base, kind="stable")
                row, _, at_base, dist = neighbours._nearest(np.arange(len(ids)), queries, np.arange(len(base)), x[order], k, metric)
                own = bounds(x[order]).reshape(len(x), trees, leaves).argmin(2) + np.arange(trees) * leaves
                need = place[row[:, None], own[at_base]].min(1) + 1
                found = np.rec.fromarrays([row, base[order][at_base], dist, need], names="row,nbr,dist,need")
                best = found if best is None else np.concatenate([best, found])
                best = best[np.lexsort((best["nbr"], best["dist"], best["row"]))]
                rank = np.arange(len(best)) - np.searchsorted(best["row"], best["row"])
                best = best[rank < k]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(best[c])) for c in ("row", "nbr", "dist", "need")], ["id", "nbr", "dist", "need"])

    found = neighbours._cut(rows.mapInArrow(exact, "id long, nbr long, dist double, need long"), k).groupBy("need").agg(F.count(F.lit(1)).alias("n")).orderBy("need").collect()  # a row a leaf at most
    reached = np.cumsum([r.n for r in found])
    return int(found[int(np.searchsorted(reached, RECALL * reached[-1]))].need)

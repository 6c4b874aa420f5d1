"""Mean shift with a flat kernel, and the bandwidth that suits a table.

Seeds are the centres of the occupied cells of a grid of the bandwidth's width. A
round moves each seed that still moves to the mean of the rows within the
bandwidth: seeds meet the rows block by block, and only counts and sums leave a
task. Where seeds came to rest, the places with most rows near are kept first and
others within the bandwidth of a kept one go, in rounds over the pairs of places
that are near each other; every row takes the nearest kept place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import neighbours
from kinweave.sources.shared import discard, materialize

SAMPLE_ROWS = 2000
_SUMS = "id long, n long, s array<double>"


def bandwidth(df: DataFrame, quantile: float = 0.3, id_col: str = "id", vec: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> float:
    """Mean distance of a row to the ``quantile``-th share of its nearest rows, over at most ``sample_rows`` rows by hash."""
    rows = neighbours._plain(df, id_col, vec, "l2")
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    x = neighbours._matrix(taken.column(1).combine_chunks())
    if not len(x):
        return 0.0
    return float(np.sort(neighbours._distances(x, x, "l2"), axis=1)[:, max(1, int(len(x) * quantile)) - 1].mean())


def _near_sums(radius: float):
    def compare(ids, x, base_ids, y):
        n, s = np.zeros(len(ids), dtype=np.int64), np.zeros(x.shape)
        for at in range(0, len(base_ids), neighbours.TILE_ROWS):
            tile = y[at:at + neighbours.TILE_ROWS]
            near = neighbours._distances(x, tile, "l2") <= radius
            n += near.sum(1)
            s += near @ tile
        return ids, n, s

    return compare


def _sum_batch(found) -> pa.RecordBatch:
    ids, n, s = found
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), lists], ["id", "n", "s"])


def _keep_first(places: DataFrame, near: DataFrame) -> DataFrame:
    """``places`` (id, n) in order of n and id, without those near (a, b) an earlier kept one."""
    better = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("i"))
    rank = places.select("id", better.alias("p"))
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = both.join(rank.withColumnRenamed("id", "a").withColumnRenamed("p", "pa"), "a").join(rank.withColumnRenamed("id", "b").withColumnRenamed("p", "pb"), "b")
    edges, left, kept = materialize(edges, "near"), materialize(places.select("id"), "left"), []
    while not left.isEmpty():
        beaten = edges.filter("pa < pb").select(F.col("a").alias("id")).distinct()
        winners = materialize(left.join(beaten, "id", "left_anti"), "kept")
        kept.append(winners)
        gone = edges.join(winners.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).unionByName(winners).distinct()
        gone = materialize(gone, "gone")
        left = materialize(left.join(gone, "id", "left_anti"), "left")
        edges = materialize(edges.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"), "near")
    out = kept[0] if kept else places.select("id").limit(0)
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def mean_shift(df: DataFrame, radius: float | None = None, quantile: float = 0.3, id_col: str = "id", vec: str = "embedding", max_iter: int = 300, binned: bool = True, block_rows: int | None = None, broadcast_bytes: int = neighbours.BROADCAST_BYTES) -> DataFrame:
    """(id, label): clusters in order of how many rows are near their places; rows without a vector are left out.

    ``binned`` False starts a seed at every distinct row.
    """
    rows = materialize(neighbours._plain(df, id_col, vec, "l2"), "shift-rows")
    radius = bandwidth(rows, quantile, "id", "v") if radius is None else radius
    if radius <= 0:  # all rows are equal, or there are none
        radius = 1e-12
    at = F.transform("v", lambda x: F.round(x / radius) * radius) if binned else F.col("v")
    seeds = rows.select(at.alias("v"), "id").groupBy("v").agg(F.min("id").alias("id"))
    moving, rest = materialize(seeds.select("id", "v"), "seeds"), []
    for step in range(max_iter):
        sums, _ = neighbours._compared(rows, _near_sums(radius), block_rows, broadcast_bytes, moving, _sum_batch, _SUMS)
        whole = sums.select("id", "n", F.posexplode("s").alias("i", "x")).groupBy("id", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        mean = F.struct("i", (F.col("x") / F.col("n")).alias("x"))
        means = whole.filter("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(mean)), lambda e: e["x"]).alias("m"))
        both = moving.join(means, "id")
        far = F.sqrt(F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d))
        now = materialize(both.select("id", F.col("m").alias("v"), "n", (far > 1e-3 * radius).alias("on")), "shifted")
        rest.append(now.filter("not on").select("id", "v"))
        discard(moving)
        moving = materialize(now.filter("on").select("id", "v"), "seeds")
        if moving.isEmpty():
            break
    places = moving
    for part in rest:
        places = places.unionByName(part)
    places = places.groupBy(F.transform("v", lambda x: F.round(x / (1e-3 * radius))).alias("cell")).agg(F.min(F.struct("id", "v")).alias("m")).select("m.id", "m.v")
    places = materialize(places, "places")
    counts, _ = neighbours._compared(rows, _near_sums(radius), block_rows, broadcast_bytes, places, _sum_batch, _SUMS)
    counts = materialize(counts.groupBy("id").agg(F.sum("n").alias("n")), "counts")
    near = neighbours.radius_pairs(places, radius, "l2", "id", "v", block_rows, broadcast_bytes).filter("id < nbr").select(F.col("id").alias("a"), F.col("nbr").alias("b"))
    kept = materialize(_keep_first(counts, near), "kept")
    named = kept.join(counts, "id").orderBy(F.desc("n"), "id").select("id").toArrow()  # a row for each cluster
    centres = places.join(kept, "id", "left_semi")
    lists, _ = neighbours._compared(centres, lambda i, x, j, y: neighbours._nearest(i, x, j, y, 1, "l2"), block_rows, broadcast_bytes, rows)
    nearest = lists.groupBy("id").agg(F.min(F.struct("dist", "nbr")).alias("m")).select("id", F.col("m.nbr").alias("place"))
    spark = df.sparkSession
    label = spark.createDataFrame([(int(i), k) for k, i in enumerate(named.column(0).to_pylist())], "place long, label int")
    return nearest.join(F.broadcast(label) if named.num_rows <= 100_000 else label, "place").select("id", "label")

"""Connected components: the smallest node id that each node reaches.

Edges first shrink to spanning forests inside their tasks. Then large-star and
small-star rounds run as aggregates and joins, each written to the shared
folder, until the edges no longer change. A graph of at most ``local_edges``
edges is finished by one task instead (a round costs about a second).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.forest import star_forest
from kinweave.sources.shared import materialize

LOCAL_EDGES = 500_000
_CHUNK = 1_000_000


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace every run of about a million edges by its spanning forest (u > v, v its root) and its self edges."""
    us, vs, n = [], [], 0

    def flush() -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        loops = np.unique(u[u == v])
        u, v = (np.concatenate([x, loops]) for x in star_forest(u, v))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        n += len(us[-1])
        if n >= _CHUNK:
            yield flush()
            us, vs, n = [], [], 0
    if n:
        yield flush()


def _forests(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest_batches, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))  # every edge has u > v
    linked = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return linked.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES, max_rounds: int = 64) -> DataFrame:
    """(id, comp) of every node of the edges ``(a, b)``; ids are longs, self edges and nulls are ignored.

    A node whose only edge is a self edge is its own component.
    """
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null")
    reduced = materialize(_forests(plain), "forest")
    loops = reduced.filter("u = v").select(F.col("u").alias("id"), F.col("u").alias("comp"))
    current = reduced.filter("u <> v")
    n = current.count()
    if n <= local_edges:
        current = materialize(_forests(current.coalesce(1)), "forest") if n else current
    else:
        mark = None
        for _ in range(max_rounds):
            current = materialize(_small_star(_large_star(current)), "star")
            now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    # star edges: every member has one root, roots are their own
    return members.unionByName(roots).unionByName(loops).groupBy("id").agg(F.min("comp").alias("comp"))

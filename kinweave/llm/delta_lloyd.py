"""Delta Lloyd: k-means on integer vectors with persisted assignments and global sums.

Every vector's cluster and squared distance are kept in a written table, every
cluster's count and component sums on the driver (``clusters`` x ``dims``
integers, whatever the number of vectors). A round compares a vector whose
owner stood still with the moved centroids only, since its distances to all
others are known not to win; a vector whose owner moved meets all centroids.
Vectors that change hands leave signed integer transfers (taken from the old
owner, given to the new one), which tasks add up before one row a task and
cluster is shuffled. All arithmetic is on integers and exact.

Defined cases: vectors of another width, and ones that are null or hold a null
or a non-finite component, take no part; neither do vectors whose scaled
squared length is 2^60 or more, as their squared distances need not fit a long.
Repeated rows count again. A null id takes part and is hashed as an empty one.
Fewer vectors than ``clusters`` give as many clusters as vectors; an empty table
gives an empty result. Ties in the hash order of the first centroids go to the
smaller vector, ties in distance to the smaller cluster number. An empty cluster
keeps its centroid. Extra columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources.shared import discard, materialize

#: Scaled squared lengths below this keep all distances inside a long.
MOST_SQUARE = float(1 << 60)
#: Below this, float64 products and their sums are exact.
EXACT_SQUARE = float(1 << 50)
_STATE = "id long, q array<long>, cluster int, distance long, owner int"


@dataclass
class Clustering:
    """``rows`` (id, q, cluster, distance, owner: the cluster before the last assignment) and the centroids they were assigned to."""

    rows: DataFrame
    centroids: np.ndarray
    changed: list[int]  # centroids that moved before each assignment


def quantise(df: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, q): floor(scale * x) of each component of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("x")).filter(F.size("x") == dims)
    finite = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    short = finite.filter(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) * float(scale * scale) < MOST_SQUARE)
    return short.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))


def first_centroids(rows: DataFrame, clusters: int, prefix: str = "1:") -> np.ndarray:
    """The vectors with the smallest hex SHA-256 of ``prefix`` and id, in hash order."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()  # at most ``clusters`` rows
    return np.array([r.q for r in sorted(found, key=lambda r: (r.key, r.q))], dtype=np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared_distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances (long) of the integer rows of x to those of ``centre``."""
    xf, cf = x.astype(np.float64), centre.astype(np.float64)
    own, other = (xf * xf).sum(1), (cf * cf).sum(1)
    if max(own.max(initial=0), other.max(initial=0)) < EXACT_SQUARE:
        return (own[:, None] + other[None, :] - 2 * (xf @ cf.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centre], axis=1)


def reassigned(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centre: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) after the centroids flagged in ``moved`` took their places in ``centre``."""
    cluster, distance = cluster.copy(), distance.copy()
    free = moved[cluster]  # the owner moved: all centroids compete
    if free.any():
        d = squared_distances(x[free], centre)
        cluster[free] = d.argmin(1)
        distance[free] = d.min(1)
    kept, rivals = np.flatnonzero(~free), np.flatnonzero(moved)
    if len(kept) and len(rivals):
        d = squared_distances(x[kept], centre[rivals])
        best, least = rivals[d.argmin(1)], d.min(1)
        wins = (least < distance[kept]) | ((least == distance[kept]) & (best < cluster[kept]))
        cluster[kept[wins]], distance[kept[wins]] = best[wins], least[wins]
    return cluster, distance


def _batch(ids: pa.Array, q: pa.Array, cluster: np.ndarray, distance: np.ndarray, owner: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, q, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), owner], ["id", "q", "cluster", "distance", "owner"])


def _first_assignment(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared_distances(_matrix(batch.column(1)), centre)
                yield _batch(batch.column(0), batch.column(1), d.argmin(1), d.min(1), pa.nulls(batch.num_rows, pa.int32()))

    return run


def _next_assignment(centre: np.ndarray, moved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = reassigned(_matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), centre, moved)
                yield _batch(batch.column(0), batch.column(1), cluster, distance, batch.column(2))

    return run


def _transfer_batches(clusters: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, dims + 1), dtype=np.int64)  # the count last
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([_matrix(batch.column(0)), np.ones((batch.num_rows, 1), dtype=np.int64)], axis=1)
                np.add.at(sums, batch.column(1).to_numpy(), x)
                left = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                np.subtract.at(sums, batch.column(2).drop_null().to_numpy(), x[left])
        touched = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(sums[touched].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


def _transfers(rows: DataFrame, clusters: int, dims: int) -> list[list[int]]:
    """Signed changes of each cluster's sums and count (last) by the last assignment."""
    moved = rows.filter("owner is null or owner <> cluster").select("q", "cluster", "owner")
    parts = moved.mapInArrow(_transfer_batches(clusters, dims), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "s"))
    total = [[0] * (dims + 1) for _ in range(clusters)]
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # a row for each cluster and component
        total[r.cluster][r["at"]] = int(r.s)
    return total


def delta_lloyd(rows: DataFrame, clusters: int = 16, rounds: int = 3, prefix: str = "1:") -> Clustering | None:
    """``rounds`` of assignment and update over (id, q) and a last assignment; None where there are no rows.

    Stops early when no centroid moves, as nothing could change any more.
    """
    rows = materialize(rows, "integer-vectors")
    centre = first_centroids(rows, clusters, prefix)
    if not len(centre):
        return None
    k, dims = centre.shape
    state = materialize(rows.mapInArrow(_first_assignment(centre), _STATE), "assignments")
    sums, changed = [[0] * (dims + 1) for _ in range(k)], [list(range(k))]
    for _ in range(rounds):
        sums = [[a + b for a, b in zip(old, new)] for old, new in zip(sums, _transfers(state, k, dims))]
        now = np.array([[s // each[-1] for s in each[:-1]] if each[-1] else own.tolist() for each, own in zip(sums, centre)], dtype=np.int64)
        moved, centre = (now != centre).any(1), now
        if not moved.any():
            break
        changed.append(np.flatnonzero(moved).tolist())
        before, state = state, materialize(state.mapInArrow(_next_assignment(centre, moved), _STATE), "assignments")
        discard(before)
    discard(rows)
    return Clustering(state, centre, changed)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster_digests(found: Clustering | None, empty: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector; ``empty`` lends its session."""
    out = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = empty.sparkSession
    if found is None:
        return spark.createDataFrame([], out)
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # a row for each cluster
    total = sum(int(r.s) for r in sums)
    each = spark.createDataFrame([(r.cluster, int(r.s), total, centroid_digest(found.centroids[r.cluster])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.rows.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(each), "cluster")  # a row for each cluster
    return joined.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = 16, dims: int = 64, rounds: int = 3) -> str:
    """DuckDB SQL: every round is an assignment and an update as common tables."""
    squared = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        "x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * 64) AS x FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(x, lambda e: floor(e)::BIGINT) AS q FROM x WHERE list_sum(list_transform(x, lambda e: e * e)) < 1152921504606846976)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INTEGER AS cluster, q FROM v QUALIFY cluster < {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.row, min((d, cluster)) AS best FROM (SELECT v.row, c.cluster, {squared}::BIGINT AS d FROM v, c{r} c) v GROUP BY v.row)")
        if r < rounds:
            parts.append(
                f"e{r} AS (SELECT a.best[2] AS cluster, i, (sum(v.q[i]::HUGEINT), count(*)) AS s FROM a{r} a JOIN v ON a.row = v.row, range(1, {dims + 1}) t(i) GROUP BY ALL),"
                f" m{r} AS (SELECT cluster, list((s[1] // s[2] - (s[1] % s[2] < 0)::INTEGER)::BIGINT ORDER BY i) AS q FROM e{r} GROUP BY cluster),"
                f" c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)"
            )
    last = rounds
    return (
        f"WITH {', '.join(parts)} SELECT v.vec_id, a.best[2] AS cluster, a.best[1] AS distance, (sum(a.best[1]) OVER (PARTITION BY a.best[2]))::BIGINT AS cluster_inertia,"
        f" (sum(a.best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{last} a JOIN v ON a.row = v.row JOIN c{last} c ON a.best[2] = c.cluster"
    )


ORACLE = _sql()

"""k-means by Lloyd's steps, with the loss of every step; assignment to given centres.

A step is one pass: tasks compare blocks of rows with the centres by matrix
products and hand on, for every centre, the number, sum and squared distance of
their rows; one row a centre reaches the driver. An empty centre takes the place
of the largest one's, both moved apart a little. The centres (``clusters`` x width
numbers) go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import neighbours
from kinweave.sources.shared import materialize

_APART = 1 / 1024


def _closest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) nearest to each row, ties to the smaller number."""
    near, square = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    step = max(1, (1 << 22) // max(1, len(centre)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        d = (part * part).sum(1)[:, None] + (centre * centre).sum(1)[None] - 2 * (part @ centre.T)
        near[at:at + step] = d.argmin(1)
        square[at:at + step] = ((part - centre[near[at:at + step]]) ** 2).sum(1)
    return near, square


def assign(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """(id, label, distance) of rows (id, v): the nearest of the given centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, square = _closest(neighbours._matrix(b.column(1)), centre)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(np.sqrt(square))], ["id", "label", "distance"])

    return rows.mapInArrow(run, "id long, label int, distance double")


def _moments(rows: DataFrame, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(rows, sums, loss) of each centre's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), centre.shape[1] + 2))
        for b in batches:
            if b.num_rows:
                x = neighbours._matrix(b.column(1))
                near, square = _closest(x, centre)
                order = np.argsort(near, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
                total[near[order][heads]] += np.add.reduceat(np.column_stack([x, np.ones(len(x)), square])[order], heads)
        used = np.flatnonzero(total[:, -2])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].tolist(), pa.list_(pa.float64()))], ["label", "m"])

    parts = rows.mapInArrow(run, "label long, m array<double>").select("label", F.posexplode("m").alias("i", "v"))
    summed = parts.groupBy("label", "i").agg(F.sum("v").alias("v")).toArrow()  # a row for each number of each centre
    out = np.zeros((len(centre), centre.shape[1] + 2))
    out[summed.column(0).to_numpy(), summed.column(1).to_numpy()] = summed.column(2).to_numpy()
    return out[:, -2], out[:, :-2], float(out[:, -1].sum())


def moved(centre: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The centres after a step: means, and a split of the largest for each empty one."""
    out, size = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre), n.copy()
    for empty in np.flatnonzero(n == 0):
        big = int(size.argmax())
        sign = np.where(np.arange(centre.shape[1]) % 2 == 0, 1, -1) * _APART
        out[empty], out[big] = out[big] * (1 + sign), out[big] * (1 - sign)
        size[empty] = size[big] / 2
        size[big] /= 2
    return out


def lloyd(df: DataFrame, clusters: int, id_col: str = "id", vec: str = "embedding", start: np.ndarray | None = None, steps: int = 20, seed: int = 0) -> tuple[DataFrame, np.ndarray, list[float]]:
    """((id, label, distance), centres, loss before each step and at the end).

    ``start`` are the first centres, by default rows by hash of their ids. Fewer
    distinct rows than ``clusters`` leave centres without rows; rows without a
    vector take no part.
    """
    rows = materialize(neighbours._plain(df, id_col, vec, "l2"), "lloyd-rows")
    if start is None:
        first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(clusters).collect()  # ``clusters`` rows
        start = np.array([r.v for r in first])
    if not len(start):
        return rows.select("id", F.lit(0).alias("label"), F.lit(0.0).alias("distance")), start, []
    centre, trace = np.array(start, dtype=np.float64), []
    for _ in range(steps):
        n, total, loss = _moments(rows, centre)
        trace.append(loss)
        if len(trace) > 1 and trace[-2] == loss:
            break
        centre = moved(centre, n, total)
    trace.append(_moments(rows, centre)[2])
    return assign(rows, centre), centre, trace

"""Helpers for Arrow batches of texts and of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once by a Python worker.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about equal bytes, at most about ``limit`` (one row at least)."""
    sizes = [value.as_buffer().size if value.is_valid else 0 for value in batch.column(column)]
    total = sum(sizes)
    target = total / max(1, -(-total // limit))
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size / 2 > target:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def unsliced(values: pa.Array) -> pa.Array:
    """``values`` in buffers of their own; some string kernels misread arrays whose content begins inside a buffer."""
    return values.take(pa.array(np.arange(len(values))))


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    added, total = None, 0
    for batch in batches:
        for vector, n in zip(batch.column(0), batch.column(1)):
            one = np.frombuffer(vector.as_buffer(), dtype=np.float64)
            added, total = (one.copy() if added is None else added + one), total + n.as_py()
    if added is not None:
        yield pa.RecordBatch.from_arrays([pa.array([added.tobytes()], pa.binary()), pa.array([total], pa.int64())], ["vector", "total"])


def tree_sum(rows: DataFrame, fan: int = 16) -> tuple[np.ndarray | None, int]:
    """Sums of the columns (vector of doubles as binary, total long) of ``rows``.

    Tasks add what they hold, then every ``fan`` tasks meet in one, until at
    most ``fan`` vectors of one length reach the driver.
    """
    parts = rows.rdd.getNumPartitions()
    rows = rows.mapInArrow(_vector_batches, "vector binary, total long")
    while parts > fan:
        parts = -(-parts // fan)
        rows = rows.repartition(parts).mapInArrow(_vector_batches, "vector binary, total long")
    found = rows.collect()
    if not found:
        return None, 0
    return sum(np.frombuffer(r.vector, dtype=np.float64) for r in found), sum(r.total for r in found)

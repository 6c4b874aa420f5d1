"""Tables written to the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. It is read from the session; only
where it is unset and the master is local (tests, a laptop) a folder of our own
takes its place. A written table cuts lineage and survives the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("kinweave_scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that the body writes, filled as it goes on; other threads and queries write to lists of their own."""
    paths: list[str] = []
    mark = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield paths
    finally:
        _SCOPES.reset(mark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder, deleted with this application's tables."""
    path = f"{shared_dir(spark)}/kinweave/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    for paths in _SCOPES.get():
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kinweave_path = path
    return table


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete ``paths`` (by default all) of what this application wrote to the shared folder; returns how many."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths = [p for p in (list(held) if paths is None else paths) if p in set(held)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        held.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for table in tables:
        release(table.sparkSession, [table.kinweave_path])

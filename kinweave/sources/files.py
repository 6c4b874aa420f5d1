"""Readers and writers: raw feature files, labels, lists, neighbour tables, clusters, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_features(spark: SparkSession, path: str, dims: int = 256, model: str | None = None) -> DataFrame:
    """(id, embedding) of a flat little-endian float32 file, ids by place; raises if its size is no multiple of a row.

    The file is split at rows, so its size does not matter.
    """
    width = 4 * dims
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size % width:
        raise ValueError(f"{size} bytes are no multiple of {width}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                content = batch.column(1)  # values of one width lie end to end
                first = content.offset * width if content.buffers()[1] is None else np.frombuffer(content.buffers()[1], dtype=np.int32 if pa.types.is_binary(content.type) else np.int64)[content.offset]
                x = np.frombuffer(content.buffers()[2], dtype="<f4", offset=int(first), count=batch.num_rows * dims)
                vectors = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, dims, dtype=np.int32), pa.array(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], ["id", "embedding"])

    # the only source of fixed-length records that Spark has; its rows stay in the JVM until Arrow takes them
    records = spark.sparkContext._jsc.binaryRecords(path, width).rdd()
    binary = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.BINARY()
    held = DataFrame(spark._jsparkSession.createDataset(records, binary).toDF(), spark)
    out = _by_place(held).mapInArrow(rows, "id long, embedding array<float>")
    return out if model is None else out.select(F.lit(model).alias("model"), "id", "embedding")


def write_features(df: DataFrame, path: str, id_col: str = "id", vec: str = "embedding") -> None:
    """Parquet (id, embedding) in order of id."""
    df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>").alias("embedding")).orderBy("id").write.mode("overwrite").parquet(path)


def _by_place(rows: DataFrame) -> DataFrame:
    """(id, value) of rows (value) in order of their splits, counted per split, then summed."""
    rows = rows.select("value", F.monotonically_increasing_id().alias("m"))
    split = F.shiftrightunsigned("m", 33)
    counts = rows.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = counts.select("split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.withColumn("split", split).join(F.broadcast(starts), "split").select((F.col("start") + F.col("m") - F.col("first")).alias("id"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a text file, ids by place in the file."""
    return _by_place(spark.read.text(path))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(id, item): one item per line."""
    return _lines(spark, path).select("id", F.col("value").alias("item"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): one integer per line."""
    return _lines(spark, path).select("id", F.trim("value").cast("int").alias("label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """One label per line, in order of id."""
    labels.orderBy("id").select(F.col("label").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_meta(labels: DataFrame) -> tuple[DataFrame, int, int]:
    """((label, ids), number of classes, number of items)."""
    counts = labels.agg(F.count_distinct("label").alias("c"), F.count(F.lit(1)).alias("n")).first()
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids")), counts.c, counts.n


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write as Parquet (partitioned by ``by``) and read back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under ``key`` (a hash of what it was made from); ``make`` is called if it is absent."""
    path = f"{folder.rstrip('/')}/{key}"
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else write_table(make(), path)


def cached_table(df: DataFrame, folder: str, key: str) -> DataFrame:
    """``cached`` for a table at hand."""
    return cached(df.sparkSession, folder, key, lambda: df)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def head(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The rows with id below ``n`` (a pushed-down filter)."""
    return df.filter(F.col(id_col) < n)


def first_rows(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest ids."""
    return df.orderBy(id_col).limit(n)


def _plain(value: Any) -> Any:
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    raise TypeError(type(value).__name__)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` as one file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def dump_json(spark: SparkSession, path: str, data: Any, force: bool = False) -> bool:
    """Write ``data`` as one JSON document; an existing one stays unless ``force``. True if written."""
    if exists(spark, path) and not force:
        return False
    write_text(spark, path, json.dumps(data, default=_plain, sort_keys=True))
    return True

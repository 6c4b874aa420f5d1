"""Label vectors from clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BUCKET = 1 << 14


def dense_index(keys: DataFrame, key: str, name: str = "index") -> DataFrame:
    """(key, name): 0-based place of each distinct long key in order.

    Counts per range of keys are summed first, so rows are numbered by many tasks.
    """
    rows = keys.select(key).distinct().withColumn("bucket", F.floor(F.col(key) / _BUCKET))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy(key)
    return rows.withColumn("__place", F.row_number().over(inside) - 1).join(starts, "bucket").select(key, (F.col("start") + F.col("__place")).cast("long").alias(name))


def label_items(items: DataFrame, membership: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, label) of every item: clusters numbered by their smallest member, -1 without one."""
    numbered = dense_index(membership, "comp", "label")
    placed = membership.join(numbered, "comp").select("id", F.col("label").cast("int").alias("label"))
    return items.select(F.col(id_col).alias("id")).join(placed, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def relabel(labels: DataFrame) -> DataFrame:
    """(id, label): dense labels in order of first appearance by id; -1 stays."""
    first = labels.filter("label <> -1").groupBy("label").agg(F.min("id").alias("comp"))
    numbered = first.join(dense_index(first, "comp", "new"), "comp").select("label", "new")
    return labels.join(numbered, "label", "left").select("id", F.coalesce(F.col("new").cast("int"), F.lit(-1)).alias("label"))


def keep_singletons(labels: DataFrame) -> DataFrame:
    """(id, label): each -1 becomes a cluster of its own, numbered after the others by id."""
    n = labels.agg((F.coalesce(F.max("label"), F.lit(-1)) + 1).alias("n"))
    alone = dense_index(labels.filter("label = -1"), "id", "place")
    joined = labels.join(alone, "id", "left").crossJoin(F.broadcast(n))  # one row
    return joined.select("id", F.when(F.col("label") == -1, F.col("n") + F.col("place")).otherwise(F.col("label")).cast("int").alias("label"))


def members(labels: DataFrame) -> DataFrame:
    """(label, ids): sorted members of each label."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))

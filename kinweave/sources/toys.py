"""Two-dimensional toy data of known shapes, generated on executors from seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shape(spark: SparkSession, n: int, x: Column, y: Column, label: Column) -> DataFrame:
    return spark.range(n).select("id", F.array(x, y).alias("embedding"), label.cast("int").alias("label"))


def circles(spark: SparkSession, n: int = 1500, factor: float = 0.5, noise: float = 0.05, seed: int = 0) -> DataFrame:
    label = F.col("id") % 2
    angle, r = F.rand(seed) * 2 * math.pi, F.when(label == 0, 1.0).otherwise(factor)
    return _shape(spark, n, r * F.cos(angle) + F.randn(seed + 1) * noise, r * F.sin(angle) + F.randn(seed + 2) * noise, label)


def moons(spark: SparkSession, n: int = 1500, noise: float = 0.05, seed: int = 0) -> DataFrame:
    label = F.col("id") % 2
    angle = F.rand(seed) * math.pi
    x = F.when(label == 0, F.cos(angle)).otherwise(1 - F.cos(angle))
    y = F.when(label == 0, F.sin(angle)).otherwise(0.5 - F.sin(angle))
    return _shape(spark, n, x + F.randn(seed + 1) * noise, y + F.randn(seed + 2) * noise, label)


def blobs(spark: SparkSession, n: int = 1500, centres: tuple[tuple[float, float], ...] = ((-6.0, -4.0), (0.0, 5.0), (7.0, -2.0)), deviations: tuple[float, ...] = (1.0, 1.0, 1.0), seed: int = 0) -> DataFrame:
    """Normal blobs; unequal ``deviations`` give varied variance."""
    label = (F.col("id") % len(centres)).cast("int")

    def pick(values) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), label)

    return _shape(spark, n, pick([c[0] for c in centres]) + F.randn(seed) * pick(deviations), pick([c[1] for c in centres]) + F.randn(seed + 1) * pick(deviations), label)


def uniform(spark: SparkSession, n: int = 1500, seed: int = 0) -> DataFrame:
    return _shape(spark, n, F.rand(seed), F.rand(seed + 1), F.lit(0))


def anisotropic(spark: SparkSession, n: int = 1500, seed: int = 0) -> DataFrame:
    """Blobs stretched by a linear map."""
    from kinweave.functions.vectors import linear_map

    stretch = [[0.6, -0.6], [-0.4, 0.8]]  # fixed values
    return blobs(spark, n, seed=seed).withColumn("embedding", linear_map(F.col("embedding"), stretch))

"""Feature transforms: unit length, standard scores, PCA whitening."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import doubles, normalise
from kinweave.sources.shared import materialize


def unit_rows(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """``df`` with vectors of length 1; a zero vector becomes null."""
    return df.withColumn(vec, normalise(doubles(vec)))


def standardise(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """``df`` with mean 0 and (population) deviation 1 in every column; constant columns become 0."""
    rows = df.withColumn("__v", array_to_vector(doubles(vec)))
    model = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(rows)
    n = rows.count()
    scale = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # from sample to population deviation
    return model.transform(rows).withColumn(vec, F.transform(vector_to_array("__s"), lambda x: x * scale)).drop("__v", "__s")


def _moment_batches(batches):
    total, square, n = None, None, 0
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
        if x is not None:
            total = x.sum(0) if total is None else total + x.sum(0)
            square = x.T @ x if square is None else square + x.T @ x
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([square.ravel().tolist()], pa.list_(pa.float64()))], ["n", "total", "square"])


def moments(df: DataFrame, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(mean, population covariance) of all vectors.

    Moments are added in the tasks and summed by position, so the driver gets one matrix of the vectors' width.
    """
    parts = materialize(df.select(doubles(vec).alias("v")).filter("v is not null").mapInArrow(_moment_batches, "n long, total array<double>, square array<double>"), "moments")
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("no vectors")

    def summed(column: str) -> np.ndarray:
        rows = parts.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return np.array([r.x for r in rows])

    mean = summed("total") / n
    return mean, summed("square").reshape(len(mean), -1) / n - np.outer(mean, mean)


def fit_whitening(df: DataFrame, vec: str = "embedding", dims: int = 256, eigen_power: float = -0.5, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): eigenvectors of the covariance scaled by eigenvalue ** eigen_power."""
    mean, covariance = moments(df, vec)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:dims]
    return mean, vectors[:, order] * np.maximum(values[order], eps) ** eigen_power


def whiten(df: DataFrame, mean: np.ndarray, projection: np.ndarray, vec: str = "embedding") -> DataFrame:
    """``df`` with centred, projected vectors of unit length (a zero projection stays zero)."""
    at = df.columns.index(vec)
    fields = [f for f in df.withColumn(vec, doubles(vec)).schema]

    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = (x - mean) @ projection
            size = np.sqrt((y * y).sum(1, keepdims=True))
            y = y / np.where(size == 0, 1, size)
            columns = list(batch.columns)
            columns[at] = pa.array(y.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.withColumn(vec, doubles(vec)).filter(F.col(vec).isNotNull()).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))

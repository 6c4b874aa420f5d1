"""Vector expressions over ARRAY<DOUBLE> columns; they stay on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l1", "l2", "linf", "angular", "hamming")


def doubles(v: Column | str) -> Column:
    """The vector in double precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row; inside a lambda an outer expression is worked out once an element."""
    return F.transform(F.array(value), f)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def normalise(x: Column) -> Column:
    """x / |x|; null for a zero vector."""
    return bound(F.nullif(norm(x), F.lit(0.0)), lambda size: F.transform(x, lambda v: v / size))


def linear_map(x: Column, matrix: list[list[float]]) -> Column:
    """x A for a small literal matrix given by rows."""
    return F.array(*[dot(x, F.array(*[F.lit(float(row[j])) for row in matrix])) for j in range(len(matrix[0]))])


def distance(x: Column, y: Column, metric: str) -> Column:
    """Distance of two vectors; ``hamming`` counts differing bits of ARRAY<BIGINT>."""
    if metric == "cosine":
        return 1 - cosine(x, y)
    if metric == "angular":
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(x, y))))
    if metric == "l1":
        return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    if metric == "l2":
        return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))
    if metric == "linf":
        return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    if metric == "hamming":
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def softmax(x: Column) -> Column:
    def shares(e: Column) -> Column:
        return bound(total(e), lambda t: F.transform(e, lambda v: v / t))

    return bound(bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))), shares)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def affine(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """W x + b; one row of ``weights`` per output."""
    return F.array(*[dot(x, F.array(*[F.lit(float(w)) for w in row])) + float(b) for row, b in zip(weights, bias)])

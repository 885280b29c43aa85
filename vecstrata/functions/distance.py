"""The three distances, as column expressions, as SQL functions and as numpy kernels.

All accumulate in double.  Cosine distance is exactly 1 if either norm is 0; the dot
product is negated, so that smaller is always closer; squared L2 takes no root.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..types import Metric, ValidationError


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot_product(a: Column, b: Column) -> Column:
    return -_dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - _dot(a, b) / norms)


_BY_METRIC = {Metric.L2: euclidean_squared, Metric.COSINE: cosine_distance, Metric.DOT: dot_product}


def metric_of(name: str) -> Metric:
    try:
        return Metric(name)
    except ValueError:
        raise ValidationError(f"unknown distance metric {name!r}") from None


def distance(metric: str, a: Column, b: Column) -> Column:
    return _BY_METRIC[metric_of(metric)](a, b)


def vector_literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)) if len(values) else F.array().cast("array<double>")


def one_to_many(metric: str, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of one vector (or of as many as there are rows) to each row, in double;
    equal rows give equal results."""
    if metric == Metric.L2:
        return ((rows - query) ** 2).sum(axis=1)
    dots = (rows * query).sum(axis=1)
    if metric == Metric.DOT:
        return -dots
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum(axis=-1))
    return np.where(norms == 0, 1.0, 1 - dots / np.where(norms == 0, 1.0, norms))


def many_to_many(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows) by matrix products: fast, right to a few units in the last places."""
    dots = queries @ rows.T
    if metric == Metric.DOT:
        return -dots
    sq, sr = (queries * queries).sum(axis=1)[:, None], (rows * rows).sum(axis=1)[None]
    if metric == Metric.L2:
        return sq - 2 * dots + sr
    norms = np.sqrt(sq) * np.sqrt(sr)
    return np.where(norms == 0, 1.0, 1 - dots / np.where(norms == 0, 1.0, norms))


def register_sql(spark: SparkSession) -> None:
    """Make the distances callable from SQL text in this session."""
    pairs = "zip_with(a, b, (x, y) -> {})"
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, v) -> s + v)"
    norms = f"sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})"
    bodies = {
        Metric.L2: "aggregate(" + pairs.format("(x - y) * (x - y)") + ", 0D, (s, v) -> s + v)",
        Metric.DOT: "-" + dot.format("a", "b"),
        Metric.COSINE: f"CASE WHEN {norms} = 0 THEN 1D ELSE 1 - {dot.format('a', 'b')} / ({norms}) END",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")

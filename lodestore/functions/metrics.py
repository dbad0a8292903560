"""Vector metrics as column expressions, computed in double precision.

score: larger is better (cosine with 1e-8 added to each norm, inner product, negative
Euclidean distance).  distance: smaller is better (1 - cosine, negative inner
product, squared Euclidean distance).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric

EPSILON = 1e-8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null when lengths differ."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null when lengths differ."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def score(a: Column, b: Column, metric: Metric | str) -> Column:
    """Larger is better."""
    metric = Metric.parse(metric)
    if metric is Metric.COSINE:
        return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))
    return dot(a, b) if metric is Metric.IP else -F.sqrt(l2_squared(a, b))


def distance(a: Column, b: Column, metric: Metric | str, normalized: bool = False) -> Column:
    """Smaller is better; normalized: both vectors have length 1, so cosine needs no norms."""
    metric = Metric.parse(metric)
    if metric is Metric.COSINE:
        return 1 - dot(a, b) if normalized else cosine_distance(a, b)
    return -dot(a, b) if metric is Metric.IP else l2_squared(a, b)


def normalize(a: Column) -> Column:
    """A vector divided by its length plus 1e-8, as floats."""
    size = norm(a) + EPSILON
    return F.transform(a, lambda x: (x.cast("double") / size).cast("float"))


def fit_dim(a: Column, dim: int) -> Column:
    """A vector cut to dim components, or filled up with zeros."""
    return F.when(F.size(a) >= dim, F.slice(a, 1, dim)).otherwise(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size(a))))


def zeros(dim: int) -> Column:
    """A zero centroid."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def require_dim(a: Column, dim: int) -> Column:
    """The vector; an error for one of another length or with null components."""
    fine = (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull())
    return F.when(fine, a).otherwise(F.raise_error(F.concat(F.lit(f"expected a vector of {dim} components, got "), F.size(a).cast("string"))).cast("array<float>"))

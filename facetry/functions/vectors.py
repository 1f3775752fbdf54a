"""Dense vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.runtime import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector, the norm floored at 1e-8."""
    # inside the lambda the length would be taken again for every component
    return let(F.greatest(norm(a), F.lit(1e-8)), lambda length: F.transform(a, lambda v: v / length))


def cosine_dense(a: Column, b: Column) -> Column:
    floor = F.lit(1e-8)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def euclidean(a: Column, b: Column) -> Column:
    """L2 distance, null for vectors of different length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(
        F.size(a) == F.size(b),
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)),
    )


def project_whitened(vector: Column, mu: Column, sigma: Column, axes: Column) -> Column:
    """``axes . ((vector - mu) / max(sigma, 1e-8))`` as an array, one value per axis."""
    centred = F.zip_with(vector, mu, lambda e, m: e - m)
    white = F.zip_with(centred, sigma, lambda c, s: c / F.greatest(s, F.lit(1e-8)))
    return F.transform(axes, lambda axis: dot(white, axis))


def normalize_robust(value: Column, p02: Column, p50: Column, p98: Column) -> Column:
    """Median-anchored scaling with separate up and down ranges, clipped to [-1, 1].

    Without a median the older range form maps p02..p98 onto [-1, 1].
    """
    floor = F.lit(1e-8)
    scale = F.when(value >= p50, F.greatest(floor, p98 - p50)).otherwise(
        F.greatest(floor, p50 - p02)
    )
    one = F.lit(1.0)
    anchored = F.least(F.greatest((value - p50) / scale, -one), one)
    share = F.least(F.greatest((value - p02) / F.greatest(floor, p98 - p02), F.lit(0.0)), one)
    return F.when(p50.isNotNull(), anchored).otherwise(share * 2 - 1)

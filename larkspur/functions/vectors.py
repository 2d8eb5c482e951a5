"""Distances of vectors held as arrays of numbers, and nearest neighbours.

All are built from higher-order functions, so they stay in the JVM. Vectors of different lengths fail, as does any other
misuse; a null vector or component gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(a: Column, b: Column, value: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) != F.size(b)), bad.cast("double")).otherwise(value)


def _fold(a: Column, b: Column, term) -> Column:
    both = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(both, F.lit(0.0), lambda s, t: s + t)


def l2_squared_distance(a: Column, b: Column) -> Column:
    return _checked(a, b, _fold(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    """a <-> b"""
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _checked(a, b, _fold(a, b, lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    """a <#> b"""
    return -inner_product(a, b)


def l1_distance(a: Column, b: Column) -> Column:
    """a <+> b"""
    return _checked(a, b, _fold(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.when(size > 0, size))))


def cosine_distance(a: Column, b: Column) -> Column:
    """a <=> b; NaN where a vector is zero"""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(1 - _cosine(a, b), F.lit(float("nan"))))


def spherical_distance(a: Column, b: Column) -> Column:
    """The angle between unit vectors, over pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b)))) / F.pi()


DISTANCES = {
    "l2": l2_distance,
    "l2_squared": l2_squared_distance,
    "inner_product": inner_product,
    "negative_inner_product": negative_inner_product,
    "cosine": cosine_distance,
    "l1": l1_distance,
    "spherical": spherical_distance,
}


def nearest(df: DataFrame, vec_col: str, query: list[float], k: int, distance: str = "l2", tie: str | None = None) -> DataFrame:
    """The k rows nearest to query, with distance; ties by the column tie. Each partition keeps k rows, and those meet."""
    q = F.array(*[F.lit(float(x)) for x in query])
    far = DISTANCES[distance](F.col(vec_col), q)
    return df.withColumn("distance", far).orderBy(F.col("distance").asc_nulls_last(), *([tie] if tie else [])).limit(k)

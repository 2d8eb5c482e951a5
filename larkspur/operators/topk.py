"""Bounded sorts: top-k with ties, distinct on, and late columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pg_order(*keys: str) -> list[Column]:
    """Sort columns in PostgreSQL's null order; "-x" is descending (nulls first)."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def with_ties(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES. The n-th key bounds the scan; no window holds all rows."""
    bound = df.select(*[F.col(k.lstrip("-")) for k in keys]).orderBy(*pg_order(*keys)).limit(n)
    last = bound.orderBy(*[F.col(k[1:]).asc_nulls_last() if k.startswith("-") else F.col(k).desc_nulls_first() for k in keys]).limit(1)
    names = [k.lstrip("-") for k in keys]
    edge = last.select(*[F.col(n).alias(f"__edge_{n}") for n in names])
    beyond = F.lit(False)
    for k, name in reversed(list(zip(keys, names, strict=True))):
        x, e = F.col(name), F.col(f"__edge_{name}")
        if k.startswith("-"):
            before = F.coalesce(x > e, F.lit(False)) | (x.isNull() & e.isNotNull())
        else:
            before = F.coalesce(x < e, F.lit(False)) | (x.isNotNull() & e.isNull())
        beyond = before | (x.eqNullSafe(e) & (beyond if k is not keys[-1] else F.lit(True)))
    return df.join(F.broadcast(edge), beyond).drop(*edge.columns)


def distinct_on(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """SELECT DISTINCT ON (keys) ... ORDER BY keys, order: the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*pg_order(*order))
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def late_columns(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The top n of a wide table: sort the sort columns and a unique key only, then fetch the rows of the survivors."""
    names = [k.lstrip("-") for k in order]
    survivors = df.select(key, *[c for c in names if c != key]).orderBy(*pg_order(*order)).limit(n).select(key)
    return df.join(F.broadcast(survivors), key, "left_semi").orderBy(*pg_order(*order))

"""Joins that need more than a join type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is within limit, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """left rows whose key is NOT IN right's keys: no row if any of those is null, and no null key unless there are none."""
    facts = right.agg(F.count("*").alias("__n"), F.count(right_key).alias("__known"))
    rows = left.join(right.select(F.col(right_key).alias("__key")).distinct(), F.col(left_key) == F.col("__key"), "left_anti")
    n, known = facts.first()
    if n > known:
        return rows.limit(0)
    return rows if n == 0 else rows.where(F.col(left_key).isNotNull())


def join_aggregates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two aggregations by the same keys side by side; null keys meet."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, condition).drop(*[f"__{k}" for k in keys])


def salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An inner, left, semi or anti join on keys of which a few hold many of left's rows: left's rows are dealt over salts, right's rows copied to each."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of the same by whose right_on is not after its on.

    Both sides are put in one order and the last right row is carried on, so nothing is compared pairwise.
    """
    a = left.select("*", F.col(on).alias("__at"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in columns], F.lit(False).alias("__there"))
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_on).alias("__at"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__r_{c}") for c in columns], F.lit(True).alias("__there"))
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.struct(*[F.col(f"__r_{c}").alias(c) for c in columns])
    both = a.unionByName(b).withColumn("__last", F.last(F.when(F.col("__there"), row), ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in columns])


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them: an equality on bins of width, then the exact test."""
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__bin").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")

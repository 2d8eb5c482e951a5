"""Aggregates with PostgreSQL's result types, and rewrites of aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def avg_numeric(x: Column, scale: int = 16) -> Column:
    """avg of integers or decimals of up to six places as a decimal: whole part and rest are divided apart, as one division would keep few places of a wide sum."""
    total, n = F.sum(x.cast("decimal(22,6)")), F.count(x).cast("decimal(18,0)")
    whole = F.floor(total / n).cast("decimal(20,0)")
    rest = (total - whole * n).cast("decimal(24,6)") / n
    return whole.cast(f"decimal(38,{scale})") + rest.cast(f"decimal({scale + 2},{scale})")


def sum_offset(x: Column, k: Column | int) -> Column:
    """sum(x + k) as sum(x) + k * count(x): one addition a group; in decimals, so that neither form can overflow where the other does not."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.sum(x.cast("decimal(19,0)")) + k * F.count(x)


def implied_keys(df: DataFrame, key: str, implied: dict[str, Column], *aggs: Column) -> DataFrame:
    """GROUP BY key and expressions of key alone: group by the key, compute the others for each group."""
    out = df.groupBy(key).agg(*aggs)
    for name, expression in implied.items():
        out = out.withColumn(name, expression)
    return out


def split_distinct(df: DataFrame, keys: list[str], distinct: str, *aggs: Column, name: str = "n_distinct") -> DataFrame:
    """count(DISTINCT distinct) beside other aggregates: two aggregations that meet by their keys, instead of expanded rows."""
    from larkspur.operators.joins import join_aggregates

    counted = df.select(*keys, distinct).distinct().groupBy(*keys).agg(F.count(distinct).alias(name))
    return join_aggregates(df.groupBy(*keys).agg(*aggs), counted, keys)


def split_distincts(df: DataFrame, keys: list[str], distinct: dict[str, tuple], *aggs: Column) -> DataFrame:
    """Several DISTINCT aggregates (name: column, function) beside others: an aggregation each, joined by the keys, where expanding would copy each row once for each of them."""
    from larkspur.operators.joins import join_aggregates

    out = df.groupBy(*keys).agg(*aggs)
    for name, (column, f) in distinct.items():
        out = join_aggregates(out, df.select(*keys, column).distinct().groupBy(*keys).agg(f(column).alias(name)), keys)
    return out


def interval_sum(iv: Column) -> Column:
    """The sum of intervals, field by field."""
    return F.struct(F.sum(iv["months"]).cast("int").alias("months"), F.sum(iv["days"]).cast("int").alias("days"), F.sum(iv["micros"]).alias("micros"))

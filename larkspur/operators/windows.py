"""Window frames that Spark's parser lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], before: int, after: int, **aggs: Column) -> DataFrame:
    """Aggregates OVER (PARTITION BY ... ORDER BY ... GROUPS BETWEEN before PRECEDING AND after FOLLOWING)."""
    ranked = df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("__group").rangeBetween(-before, after)
    return ranked.select("*", *[a.over(w).alias(n) for n, a in aggs.items()]).drop("__group")


def exclude_current(total: str, x: str, w: WindowSpec) -> Column:
    """sum or count over w EXCLUDE CURRENT ROW; total is `sum` or `count`. sum is null where no other value is in the frame."""
    own = F.col(x)
    n = F.count(own).over(w) - F.when(own.isNotNull(), 1).otherwise(0)
    if total == "count":
        return n
    return F.when(n > 0, F.sum(own).over(w) - F.coalesce(own, F.lit(0)))


def exclude_ties(df: DataFrame, partition: list[str], order: str, x: str, name: str) -> DataFrame:
    """sum(x) over the partition up to the current peers, EXCLUDE TIES: without the row's other peers."""
    w = Window.partitionBy(*partition).orderBy(F.col(order).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*partition, order)
    before = F.coalesce(F.sum(x).over(w), F.lit(0)) - F.coalesce(F.sum(x).over(peers), F.lit(0))
    n = F.count(x).over(w) - F.count(x).over(peers) + F.when(F.col(x).isNotNull(), 1).otherwise(0)
    return df.withColumn(name, F.when(n > 0, before + F.coalesce(F.col(x), F.lit(0))))

"""Where families register their queries."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.dialect import sql
from larkspur.session import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def cents(x: str) -> str:
    return f"CAST(rint({x} * 100) AS BIGINT)"


def wide(x: str, scale: int) -> str:
    """The exact sum of integers that stand for decimals, as a double: both halves are summed as bigints, which cannot overflow below 2^43 rows, and meet as one decimal."""
    return f"(CAST(CAST(sum(shiftright({x}, 20)) AS DECIMAL(38,0)) * 1048576 + CAST(sum({x} & 1048575) AS DECIMAL(38,0)) AS DOUBLE) / {scale}e0)"


#: Sums of money (sum_int and sum_big: of columns already in cents; the first fails beyond 64 bits), which the tables hold as doubles of two decimals: name, Spark's text and DuckDB's.
MONEY = {
    "sum_money": (lambda x: wide(cents(x), 100), lambda x: f"CAST(sum(CAST({x} AS DECIMAL(15,2))) AS DOUBLE)"),
    "sum_product": (lambda a, b: wide(f"({cents(a)} * {cents(b)})", 10000), lambda a, b: f"CAST(sum(CAST({a} AS DECIMAL(15,2)) * CAST({b} AS DECIMAL(15,2))) AS DOUBLE)"),
    "in_cents": (cents, lambda x: f"CAST(round({x} * 100) AS BIGINT)"),
    "sum_int": (lambda x, scale: f"(CAST(sum({x}) AS DOUBLE) / {scale}e0)", lambda x, scale: f"(CAST(sum({x}) AS DOUBLE) / {scale}e0)"),
    "sum_big": (lambda x, scale: wide(f"({x})", scale), lambda x, scale: f"(CAST(sum(CAST({x} AS HUGEINT)) AS DOUBLE) / {scale}e0)"),
    "sum_revenue": (
        lambda where="true": wide(f"(CASE WHEN {where} THEN {cents('l_extendedprice')} * (100 - {cents('l_discount')}) ELSE CAST(0 AS BIGINT) END)", 10000),
        lambda where="true": f"CAST(sum(CASE WHEN {where} THEN CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) ELSE 0 END) AS DOUBLE)",
    ),
}


def expanded(sql_text: str, which: int) -> str:
    return re.sub(r"\b(sum_money|sum_product|sum_revenue|sum_int|sum_big|in_cents)\(((?:[^()]|\([^()]*\))*)\)", lambda m: MONEY[m[1]][which](*[a.strip() for a in m[2].split(",") if a.strip()]), sql_text)


def text(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query given as SQL in PostgreSQL's dialect; oracle where DuckDB's text differs."""

    ours = expanded(spark_sql, 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with_views(spark, sf_dir, ours)
        return sql(spark, ours)

    QUERIES[name] = run
    ORACLE[name] = expanded(oracle or spark_sql, 1)


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add

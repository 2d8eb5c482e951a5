"""PostgreSQL's arithmetic where Spark's differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDER = ("smallint", "int", "bigint")


def div(a: Column, b: Column, kind: str = "int") -> Column:
    """Integer division: truncates towards zero, fails on zero; kind is the type of the wider operand."""
    return F.call_function("div", a, b).cast(kind)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a."""
    return a % b


def to_int(x: Column, kind: str = "int") -> Column:
    """A float as an integer: to the nearest, halves to even; fails beyond the type's range."""
    return F.rint(x).cast(kind)


def numeric_to_int(x: Column, kind: str = "int") -> Column:
    """A decimal as an integer: halves away from zero."""
    return F.round(x).cast(kind)


def sum_wide(x: Column) -> Column:
    """The sum of bigints as a decimal, which cannot overflow."""
    return F.sum(x.cast("decimal(19,0)"))


def trunc(x: Column, digits: int = 0) -> Column:
    scale = F.lit(10**digits)
    return F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)) / scale


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of bigints by Euclid's steps; at most 91 are needed for 64 bits."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a.cast("bigint"), F.when(g == 0, F.lit(1)).otherwise(g)) * b))

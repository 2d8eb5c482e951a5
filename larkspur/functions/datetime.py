"""Fields and truncations of dates and times that Spark lacks or counts differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JULIAN_1970 = 2440588


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def extract(field: str, x: Column) -> Column:
    """EXTRACT(field FROM x) for a date or timestamp, as a double (epoch, seconds and smaller, julian) or bigint."""
    year = F.year(x)
    seconds = F.pmod(_micros(x), F.lit(60_000_000))
    up = lambda n: F.floor((F.when(year > 0, year).otherwise(year - n) + (n - 1)) / n).cast("bigint")
    return {
        "year": lambda: year.cast("bigint"),
        "quarter": lambda: F.quarter(x).cast("bigint"),
        "month": lambda: F.month(x).cast("bigint"),
        "week": lambda: F.weekofyear(x).cast("bigint"),
        "day": lambda: F.dayofmonth(x).cast("bigint"),
        "doy": lambda: F.dayofyear(x).cast("bigint"),
        "dow": lambda: (F.dayofweek(x) - 1).cast("bigint"),
        "isodow": lambda: (F.weekday(x) + 1).cast("bigint"),
        "isoyear": lambda: F.date_part(F.lit("yearofweek"), x).cast("bigint"),
        "hour": lambda: F.hour(x).cast("bigint"),
        "minute": lambda: F.minute(x).cast("bigint"),
        "second": lambda: (seconds / 1e6).cast("double"),
        "milliseconds": lambda: (seconds / 1e3).cast("double"),
        "microseconds": lambda: seconds.cast("bigint"),
        "epoch": lambda: (_micros(x) / 1e6).cast("double"),
        "decade": lambda: F.floor(year / 10).cast("bigint"),
        "century": lambda: up(100),
        "millennium": lambda: up(1000),
        "julian": lambda: (F.date_diff(x.cast("date"), F.lit("1970-01-01").cast("date")) + JULIAN_1970 + F.pmod(_micros(x), F.lit(86_400_000_000)) / 86_400_000_000).cast("double"),
    }[field]()


def date_trunc(field: str, x: Column) -> Column:
    """date_trunc, with decade, century and millennium; the result is a timestamp without zone."""
    if field in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[field]
        year = F.year(x)
        first = F.floor(year / n) * n if n == 10 else F.floor((year - 1) / n) * n + 1
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(field, x).cast("timestamp_ntz")


def to_timestamp(seconds: Column) -> Column:
    """A timestamp from seconds since 1970."""
    return F.timestamp_seconds(seconds)


def age_months(later: Column, earlier: Column) -> Column:
    """Whole months of age(later, earlier)."""
    return F.floor(F.months_between(later, earlier) + 1e-9).cast("bigint")


def date_bin(width_micros: int, x: Column, origin: str = "2000-01-01") -> Column:
    """The start of the bin of so many microseconds, counted from origin, that holds x."""
    base = _micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros((base + F.floor((_micros(x) - base) / width_micros) * width_micros).cast("bigint")).cast("timestamp_ntz")


def interval(months: Column, days: Column, micros: Column) -> Column:
    """An interval with PostgreSQL's three fields."""
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("bigint").alias("micros"))


def add_interval(x: Column, iv: Column) -> Column:
    """x + interval: months, then days, then microseconds."""
    moved = F.add_months(x.cast("date"), iv["months"])
    clock = F.pmod(_micros(x), F.lit(86_400_000_000))
    day = F.date_add(moved, iv["days"]).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(day) + clock + iv["micros"]).cast("timestamp_ntz")

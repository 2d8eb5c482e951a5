"""Arrays, maps (hstore) and JSON under PostgreSQL's operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq_any(x: Column, array: Column) -> Column:
    """x = ANY (array), with three-valued logic."""
    return F.exists(array, lambda e: x == e)


def fetch(m: Column, key: Column | str) -> Column:
    """map -> key; null where it is missing"""
    return F.try_element_at(m, key if isinstance(key, Column) else F.lit(key))


def has_key(m: Column, key: Column | str) -> Column:
    """map ? key"""
    return F.map_contains_key(m, key)


def has_any(m: Column, keys: Column) -> Column:
    """map ?| keys"""
    return F.arrays_overlap(F.map_keys(m), keys)


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda e: F.when(e.eqNullSafe(old), new).otherwise(e))


def array_positions(a: Column, x: Column) -> Column:
    """The places (from 1) of x in a."""
    return F.filter(F.transform(a, lambda e, i: F.when(e.eqNullSafe(x), i + 1)), lambda i: i.isNotNull())


def json_field(json: Column, *path: str | int) -> Column:
    """json ->> path"""
    return F.get_json_object(json, "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path))

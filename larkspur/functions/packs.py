"""Functions with a contract: what may run before the exact one, and what it checks.

A pack declares for each function whether it never raises, raises only on what check finds, or has a prefilter that
decides most rows in the JVM; ``call`` builds the guarded expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Declared:
    name: str
    contract: str  # never_raises, check or prefilter
    run: Callable[..., Column]
    guard: Callable[..., Column] | None = None  # true for rows that the exact function must see
    otherwise: object = None


REGISTRY: dict[str, Declared] = {}


def declare(name: str, run: Callable[..., Column], contract: str = "never_raises", guard: Callable[..., Column] | None = None, otherwise: object = None) -> None:
    if contract not in ("never_raises", "check", "prefilter"):
        raise ValueError(contract)
    REGISTRY[name] = Declared(name, contract, run, guard, otherwise)


def call(name: str, *args: Column) -> Column:
    f = REGISTRY[name]
    if f.contract == "prefilter" and f.guard is not None:
        return F.when(f.guard(*args), f.run(*args)).otherwise(F.lit(f.otherwise))
    return f.run(*args)


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, f.contract) for f in REGISTRY.values()], "name string, contract string")


def _standard() -> None:
    from larkspur.functions import vectors

    for name, f in vectors.DISTANCES.items():
        declare(f"vector_{name}", f, "check")


_standard()

"""Operators whose meaning PostgreSQL takes from the types of their operands.

Spark's analyser resolves the types; its expressions know their place in the text. Where PostgreSQL means something else, the text is
changed there and analysed again, until nothing is left to change:

* ``/`` of two integers divides without a remainder.
* A cast of a float to an integer rounds to the nearest, halves to even; one of a numeric rounds halves away from zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

INTEGERS = ("tinyint", "smallint", "int", "bigint")
CONCERNED = re.compile(r"/|\bCAST\s*\(|::", re.I)
MOST = 50
#: The changed text of what has been analysed before, by its text and plan.
_KNOWN: dict[tuple[str, str], str] = {}


def each(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


def expressions(plan: JavaObject) -> Iterator[JavaObject]:
    """All expressions of a plan and of the plans of its subqueries."""
    plans = [plan]
    while plans:
        at = plans.pop()
        plans += each(at.children())
        found = list(each(at.expressions()))
        while found:
            e = found.pop()
            yield e
            found += each(e.children())
            if e.getClass().getSimpleName() in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
                plans.append(e.plan())
        if at.getClass().getSimpleName() == "WithCTE":
            plans += each(at.cteDefs())


def kind(e: JavaObject) -> str:
    return e.dataType().catalogString()


def span(e: JavaObject) -> tuple[int, int] | None:
    """Where an expression stands in the text."""
    origin = e.origin()
    if origin.objectName().isDefined() or origin.startIndex().isEmpty() or origin.stopIndex().isEmpty():
        return None
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def own_kind(operand: JavaObject, place: tuple[int, int]) -> str:
    """The type of an operand without the casts that the analyser has put around it, which stand where the whole operation does."""
    while operand.getClass().getSimpleName() == "Cast" and span(operand) == place:
        operand = operand.child()
    return kind(operand)


def outside(parts: list[str], which: str, base: int, depth: int = 0) -> int | None:
    """Where the last token of this kind stands outside brackets (or in so many)."""
    at, last, open_ = base, None, 0
    for t in parts:
        open_ += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if t.lower() == which and open_ == depth:
            last = at
        at += len(t)
    return last


def changes(text: str, plan: JavaObject) -> dict[int, tuple[int, str]]:
    """Start, end and new text of what is to be changed."""
    from larkspur.plans.dialect import tokens

    out: dict[int, tuple[int, str]] = {}
    for e in expressions(plan):
        name = e.getClass().getSimpleName()
        if name not in ("Divide", "Cast") or (place := span(e)) is None:
            continue
        here = text[place[0] : place[1]]
        if name == "Divide":
            if own_kind(e.left(), place) in INTEGERS and own_kind(e.right(), place) in INTEGERS and (at := outside(tokens(here), "/", place[0])) is not None:
                out[at] = (at + 1, " div ")
        elif kind(e) in INTEGERS and (kind(e.child()) in ("float", "double") or kind(e.child()).startswith("decimal")):
            rounded = "rint" if kind(e.child()) in ("float", "double") else "round"
            call = re.match(r"CAST\s*\(", here, re.I)
            start = place[0] + (call.end() if call else 0)
            stop = outside(tokens(here), "as", place[0], 1) if call else outside(tokens(here), "::", place[0])
            if stop and not (inner := text[start:stop].strip()).startswith(f"{rounded}("):
                out[start] = (stop, f"{rounded}({inner}) ")
    return out


def sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """spark.sql of a text whose operators mean what PostgreSQL's do."""
    df = spark.sql(text, args=args)
    if not CONCERNED.search(text):
        return df
    analysed = lambda d: d._jdf.queryExecution().analyzed()
    key = (text, re.sub(r"#\d+L?", "", analysed(df).toString()))
    if key in _KNOWN:
        return df if _KNOWN[key] == text else spark.sql(_KNOWN[key], args=args)
    changed = text
    for _ in range(MOST):
        found = changes(changed, analysed(df))
        outer = {s: v for s, v in found.items() if not any(o < s < w[0] for o, w in found.items())}  # what stands inside another change comes next time
        if not outer:
            break
        for start in sorted(outer, reverse=True):
            end, new = outer[start]
            changed = changed[:start] + new + changed[end:]
        df = spark.sql(changed, args=args)
    _KNOWN[key] = changed
    return df

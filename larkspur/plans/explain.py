"""What a plan does and why: nodes, how expressions run, and a mode that refuses slow ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Nodes that leave whole-stage code generation, and the reason to report.
SLOW = {
    "BatchEvalPython": "a row-at-a-time Python function",
    "ArrowEvalPython": "a vectorised Python function",
    "MapInPandas": "a Python function over batches",
    "MapInArrow": "a Python function over batches",
    "FlatMapGroupsInPandas": "a Python function over groups",
    "FlatMapGroupsInArrow": "a Python function over groups",
    "CartesianProduct": "a join without an equality",
    "BroadcastNestedLoopJoin": "a join without an equality",
}


def nodes(df: DataFrame) -> list[tuple[int, str, str]]:
    """Depth, name and details of each node of the physical plan."""
    out = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        m = re.match(r"([\s:|+\-]*)(?:\*\(\d+\)\s*)?(\w+)(.*)", line)
        if m:
            out.append((len(m[1]) // 3, m[2], m[3].strip()))
    return out


def reasons(df: DataFrame) -> DataFrame:
    """place, depth, node, runs (`codegen`, `jvm` or `python`) and reason of each node of df's plan."""
    rows = []
    for place, line in enumerate(df._jdf.queryExecution().executedPlan().toString().splitlines()):
        m = re.match(r"([\s:|+\-]*)(\*\(\d+\)\s*)?(\w+)(.*)", line)
        if m:
            reason = SLOW.get(m[3], "")
            runs = "python" if "Python" in m[3] or "Pandas" in m[3] or "InArrow" in m[3] else "codegen" if m[2] else "jvm"
            rows.append((place, len(m[1]) // 3, m[3], runs, reason))
    return df.sparkSession.createDataFrame(rows, "place int, depth int, node string, runs string, reason string")


class Refused(ValueError):
    """A plan that force mode does not run."""


def forced(df: DataFrame) -> DataFrame:
    """df, if no node of its plan falls back to Python or to a join without an equality."""
    found = sorted({f"{name}: {SLOW[name]}" for _, name, _ in nodes(df) if name in SLOW})
    if found:
        raise Refused("; ".join(found))
    return df


def pushed(df: DataFrame) -> list[str]:
    """The filters that reach the scans of df."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())

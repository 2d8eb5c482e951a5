"""Every registered query and its DuckDB text, but for those of the subpackage llm."""

from larkspur.queries import relational, scans, systems  # noqa: F401
from larkspur.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

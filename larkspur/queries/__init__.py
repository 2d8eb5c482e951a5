"""The registered queries by family, each with its DuckDB text where SQL can express it."""

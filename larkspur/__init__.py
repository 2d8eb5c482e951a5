"""larkspur: a Spark-first analytics engine with PostgreSQL query semantics."""

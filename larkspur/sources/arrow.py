"""Arrow out and in, with types that fail closed."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType


def egress(df: DataFrame) -> pa.Table:
    """The result as an Arrow table; each field's metadata names its SQL type. Results are gathered by the client that asks for them."""
    table = df.toArrow()
    fields = []
    for have, want in zip(table.schema, df.schema, strict=True):
        kind = want.dataType.simpleString()
        meta = {"sql_type": kind} | ({"typmod": f"{want.dataType.precision},{want.dataType.scale}"} if isinstance(want.dataType, DecimalType) else {})
        fields.append(have.with_metadata(meta))
    return table.cast(pa.schema(fields))


class Unfit(ValueError):
    """A column or value that the target type cannot hold."""


def ingest(spark: SparkSession, batches: pa.Table | Iterable[pa.RecordBatch], schema: pa.Schema | None = None) -> DataFrame:
    """A DataFrame of Arrow data. With schema every column must be there and every value fit, or the statement fails naming the column."""
    table = batches if isinstance(batches, pa.Table) else pa.Table.from_batches(list(batches))
    if schema is not None:
        columns = []
        for field in schema:
            if field.name not in table.column_names:
                raise Unfit(f"column {field.name} is missing")
            column = table.column(field.name)
            if not field.nullable and column.null_count:
                raise Unfit(f"null value in column {field.name}")
            try:
                columns.append(column.cast(field.type, safe=True))
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                raise Unfit(f"column {field.name}: {e}") from e
        table = pa.table(columns, schema=schema)
    return spark.createDataFrame(table)


def execute_many(spark: SparkSession, text: str, parameters: pa.Table) -> DataFrame:
    """A query with named parameters, run once for each row of an Arrow table of them; the results one after another."""
    from larkspur.plans.dialect import sql

    out = None
    for row in parameters.to_pylist():
        one = sql(spark, text, row)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise Unfit("no parameters")
    return out

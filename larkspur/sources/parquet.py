"""External Parquet: reading by name, and what its footers say."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


def read(spark: SparkSession, location: str, schema: StructType | None = None, glob: str = "*.parquet", recursive: bool = True) -> DataFrame:
    """A file, folder or glob. With a schema its columns are matched by name, then by name in any case; missing ones are null."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    found = reader.parquet(location)
    if schema is None:
        return found
    exact, folded = set(found.columns), {}
    for c in found.columns:
        folded.setdefault(c.lower(), []).append(c)
    columns = []
    for field in schema:
        names = [field.name] if field.name in exact else folded.get(field.name.lower(), [])
        if len(names) > 1:
            raise ValueError(f"column {field.name} fits several columns of {location}: {names}")
        columns.append((F.col(f"`{names[0]}`") if names else F.lit(None)).cast(field.dataType).alias(field.name))
    return found.select(*columns)


def _files(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(location)


def _footers(spark: SparkSession, location: str, schema: str, rows) -> DataFrame:
    """rows(path, pyarrow metadata) of each file, on the executors. Where Arrow knows the store, only the ends of the files are read; else Spark's readers give the files whole."""
    listed = _files(spark, location)
    first = listed.select("path").head()
    known = first is None or first.path.split(":")[0] in ("file", "hdfs", "s3", "s3a", "gs")

    def tails(batches):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.path:
                store, name = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
                with store.open_input_file(name) as opened:
                    out += rows(path, pq.ParquetFile(opened))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    if known:
        return listed.select("path").mapInPandas(tails, schema)

    def run(batches):
        import io

        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            out = [row for path, content in zip(batch.path, batch.content, strict=True) for row in rows(path, pq.ParquetFile(io.BytesIO(content)))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return _files(spark, location).select("path", "content").mapInPandas(run, schema)


def files(spark: SparkSession, location: str) -> DataFrame:
    """file, bytes, rows and row_groups of each file."""
    return _footers(spark, location, "file string, rows long, row_groups int", lambda path, f: [(path, f.metadata.num_rows, f.metadata.num_row_groups)]).join(_files(spark, location).select(F.col("path").alias("file"), F.col("length").alias("bytes")), "file")


def row_groups(spark: SparkSession, location: str) -> DataFrame:
    """For each row group and column its rows, nulls and least and greatest value as text."""

    def rows(path, f):
        for g in range(f.metadata.num_row_groups):
            group = f.metadata.row_group(g)
            for c in range(group.num_columns):
                column = group.column(c)
                s = column.statistics
                known = s is not None and s.has_min_max
                yield path, g, column.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, str(s.min) if known else None, str(s.max) if known else None

    return _footers(spark, location, "file string, row_group int, column_name string, rows long, nulls long, least string, greatest string", rows)


def file_schema(spark: SparkSession, location: str) -> DataFrame:
    """file, position, column_name, physical and logical type of each column."""
    return _footers(spark, location, "file string, position int, column_name string, physical string, logical string", lambda path, f: [(path, i, c.path, c.physical_type, str(c.logical_type)) for i, c in enumerate(f.schema)])


def column_list(spark: SparkSession, location: str) -> str:
    """The columns of the files as a DDL list."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.option("recursiveFileLookup", "true").parquet(location).schema)


def geo_columns(spark: SparkSession, location: str) -> DataFrame:
    """file, column_name, encoding and crs of the geometry columns that the `geo` key of the footers names."""

    def rows(path, f):
        meta = (f.schema_arrow.metadata or {}).get(b"geo")
        for name, column in (json.loads(meta)["columns"] if meta else {}).items():
            yield path, name, column.get("encoding"), json.dumps(column.get("crs")) if column.get("crs") else None

    return _footers(spark, location, "file string, column_name string, encoding string, crs string", rows)


def stats_aggregate(spark: SparkSession, location: str, *columns: str) -> DataFrame:
    """count(*), and min and max of columns, from the footers where the reader can: no data pages are read."""
    keys = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = spark.read.parquet(location).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])
        out._jdf.queryExecution().executedPlan()  # planned under these settings
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

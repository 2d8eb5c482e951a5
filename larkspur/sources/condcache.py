"""Files where no row satisfies a condition are not read again.

The first scan with a condition notes which files have rows that satisfy it. Later scans with the same condition over the same files read
those only; a file that has come since, or has changed, is read as well. Only immutable conditions may be given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConditionCache:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[tuple[str, str], dict[tuple, bool]] = {}

    def files(self, location: str) -> dict[tuple, str]:
        """Path, size and time of each file, and its path; a listing, without contents."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(location).select("path", "length", "modificationTime")
        return {tuple(r): r.path for r in listed.collect()}

    def read(self, location: str, condition: str) -> DataFrame:
        """The rows of location that satisfy condition."""
        files, known = self.files(location), self.known.setdefault((location, condition), {})
        schema = self.spark.read.option("recursiveFileLookup", "true").parquet(location).schema
        fresh = [f for f in files if f not in known]
        if fresh:
            hit = {r[0].split(":", 1)[-1].lstrip("/") for r in self.spark.read.schema(schema).parquet(*[files[f] for f in fresh]).where(condition).select("_metadata.file_path").distinct().collect()}
            known |= {f: files[f].split(":", 1)[-1].lstrip("/") in hit for f in fresh}
        some = [path for f, path in files.items() if known[f]]
        if not some:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*some).where(F.expr(condition))

    def skipped(self, location: str, condition: str) -> int:
        """How many files a scan leaves out."""
        return sum(not hit for hit in self.known.get((location, condition), {}).values())

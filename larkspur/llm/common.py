"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made where spark.checkpoint.dir is unset, by application, and paths that cut() has written.
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset: a fresh local one if all executors run in this process (tests), else one in the warehouse."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            alone = spark.sparkContext.master.split("[")[0] == "local"
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='larkspur-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/larkspur-{app}"
        place = _OWN[app]
    return place


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends here, and a lost executor costs no recomputation. release() removes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """The number of tables that cut() has written so far."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, *more: str, since: int = 0) -> None:
    """Remove what cut() has written since a mark, and these paths. Results that still read them must have been written or collected before."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in [*written[since:], *more]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    del written[since:]


def modest(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows in this session: texts are long, and the default of 10,000 rows fills executors with buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shipped(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A function that gives thing in Python workers: its contents are broadcast, its class goes along by value."""
    kind, sent = type(thing), spark.sparkContext.broadcast(vars(thing) if thing is not None else None)

    def get() -> object:
        if sent.value is None:
            return None
        out = kind.__new__(kind)
        out.__dict__ = sent.value
        return out

    return get


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names an operator gives to its own results (compared as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: Broadcasts hold at most so many bytes as text.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its rows, counted and measured, take at most BROADCAST_BYTES; else as it is, to be joined by shuffling."""
    length = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    taken = df.agg(F.sum(length.cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= BROADCAST_BYTES else df


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def carried(keep: tuple, *results: str) -> list[Column]:
    """The columns keep but for those that have the names of results."""
    low = {n.lower() for n in results}
    return [F.col(f"`{c}`") for c in keep if c.lower() not in low]

"""Tables of Parquet files with snapshots: insert, update, delete, merge, truncate, compaction, schema changes.

A table is a folder of data files, delete files and manifests. A manifest, one JSON file for each version, lists the data files of
its snapshot, the delete files that apply to them and the columns; a commit is the creation of the next manifest, which fails if another
writer has made it meanwhile (``Conflict``). Files are never changed, so a reader of a version is not disturbed.

A delete file names rows by data file and place in it; they are left out by an anti-join, never by nulls. An update
deletes rows and adds their new versions. Columns have ids: files keep the names they were written with, the manifest maps ids to
today's names, so columns can be renamed, added with a default, dropped and retyped without rewriting data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


class Violation(ValueError):
    """A row breaks a constraint."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        version = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:08d}.json", wholetext=True).first()[0])

    def _commit(self, base: int, content: dict) -> int:
        """A manifest is written under another name and then renamed, which fails if the version is there: readers see whole manifests only, and of two writers one wins."""
        version = base + 1
        at, draft = self._path(f"{self.path}/manifests/{version:08d}.json"), self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content | {"version": version}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, at, options)
        except Exception as e:
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} exists") from e
        return version

    # definition

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, partition_by: list[str] | None = None, checks: dict[str, str] | None = None) -> SnapshotTable:
        """checks: name and SQL condition of each constraint; a condition that is null holds."""
        table = cls(spark, path)
        columns = [{"id": i, "name": f.name, "type": f.dataType.json(), "nullable": f.nullable, "default": None, "stored": f"c{i}"} for i, f in enumerate(schema)]
        table._fs.mkdirs(table._path(f"{table.path}/manifests"))
        table._commit(0, {"columns": columns, "next_id": len(columns), "files": [], "deletes": [], "partition_by": partition_by or [], "checks": checks or {}})
        return table

    def schema(self, version: int | None = None) -> StructType:
        return StructType([StructField(c["name"], _type(c["type"]), c["nullable"]) for c in self.manifest(version)["columns"]])

    # reading

    def _rows(self, m: dict) -> DataFrame:
        """The rows of a snapshot with __file and __place."""
        names = [c["name"] for c in m["columns"]]
        if not m["files"]:
            empty = self.spark.createDataFrame([], StructType([StructField(c["name"], _type(c["type"])) for c in m["columns"]]))
            return empty.withColumn("__file", F.lit("")).withColumn("__place", F.lit(0).cast("long"))
        touched = {n for d in m["deletes"] for n in d["of"]}
        groups: dict[tuple[str, bool], list[dict]] = {}
        for f in m["files"]:
            groups.setdefault((json.dumps(f["columns"], sort_keys=True), f["key"] in touched), []).append(f)
        parts = []
        for (stored, hit), files in groups.items():  # one scan for all files written with the same columns, those without deleted rows apart
            kinds = json.loads(stored)
            written = StructType([StructField(f"c{i}", _type(t)) for i, t in kinds.items()])
            scan = self.spark.read.schema(written).parquet(*[f"{self.path}/{f['name']}" for f in files])
            columns = [(F.col(f"c{c['id']}") if str(c["id"]) in kinds else F.lit(c["default"])).cast(_type(c["type"])).alias(c["name"]) for c in m["columns"]]
            rows = scan.select(*columns, F.regexp_extract("_metadata.file_path", "^.*/data/(.*)$", 1).alias("__file"), F.col("_metadata.row_index").alias("__place"))
            if hit:
                here = {f["key"] for f in files}
                gone = self.spark.read.schema("__file string, __place long").parquet(*[f"{self.path}/{d['name']}" for d in m["deletes"] if here & set(d["of"])])
                rows = rows.join(gone, ["__file", "__place"], "left_anti")
            parts.append(rows)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*names, "__file", "__place")

    def read(self, version: int | None = None, where: dict[str, list] | None = None) -> DataFrame:
        """The rows of the newest or a given version; where: values of partition columns, whose folders alone are read."""
        m = self.manifest(version)
        for name, values in (where or {}).items():
            own = next(f"p{c['id']}" for c in m["columns"] if c["name"] == name)
            wanted = {"__HIVE_DEFAULT_PARTITION__" if v is None else str(v) for v in values}
            m = m | {"files": [f for f in m["files"] if own not in f.get("part", {}) or f["part"][own] in wanted]}
        rows = self._rows(m).drop("__file", "__place")
        for name, values in (where or {}).items():
            some = [v for v in values if v is not None]
            rows = rows.where(F.col(name).isin(some) | F.col(name).isNull() if len(some) < len(values) else F.col(name).isin(some))
        return rows

    # writing

    def _checked(self, rows: DataFrame, m: dict) -> DataFrame:
        """rows in the table's columns and types; a row that breaks a constraint fails the statement."""
        given = {c.lower(): c for c in rows.columns}
        columns = [(F.col(f"`{given[c['name'].lower()]}`") if c["name"].lower() in given else F.lit(c["default"])).cast(_type(c["type"])).alias(c["name"]) for c in m["columns"]]
        extra = set(given) - {c["name"].lower() for c in m["columns"]}
        if extra:
            raise Violation(f"no such columns: {sorted(extra)}")
        out = rows.select(*columns)
        rules = [(f"null value in column {c['name']}", F.col(c["name"]).isNotNull()) for c in m["columns"] if not c["nullable"]]
        rules += [(f"new row violates check constraint {name}", F.coalesce(F.expr(text), F.lit(True))) for name, text in m["checks"].items()]
        for message, holds in rules:
            first = m["columns"][0]["name"]
            out = out.withColumn(first, F.when(holds, F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(_type(m["columns"][0]["type"]))))
        return out

    def _write(self, rows: DataFrame, m: dict) -> list[dict]:
        """New data files with rows; a failed write leaves files that no manifest names."""
        folder = f"data/{uuid.uuid4().hex}"
        stored = rows.select(*[F.col(c["name"]).alias(f"c{c['id']}") for c in m["columns"]])
        ids = {c["name"]: c["id"] for c in m["columns"]}
        by = [f"p{ids[p]}" for p in m["partition_by"]]
        writer = stored.write
        if by:  # a folder for each value; a value of many rows is dealt over several tasks as the plan runs
            stored = stored.withColumns({f"p{ids[p]}": F.col(f"c{ids[p]}") for p in m["partition_by"]})
            writer = stored.hint("rebalance", *by).write.partitionBy(*by)
        writer.parquet(f"{self.path}/{folder}")
        kinds = {str(c["id"]): c["type"] for c in m["columns"]}
        part = lambda n: dict(x.split("=", 1) for x in n.split("/")[:-1])
        return [{"name": f"{folder}/{n}", "key": f"{folder.removeprefix('data/')}/{key}", "columns": kinds, "part": part(n)} for n, key in self._list(folder)]

    def _list(self, folder: str) -> list[tuple[str, str]]:
        """The Parquet files of a folder and the folders in it: their paths from there, and these as Spark writes them in file_path."""
        out, found = [], self._fs.listFiles(self._path(f"{self.path}/{folder}"), True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet"):
                out.append((path.toString().rpartition(f"{folder}/")[2], path.toUri().toString().rpartition(f"{folder}/")[2]))
        return sorted(out)

    def _deletes(self, rows: DataFrame) -> list[dict]:
        """Files that name deleted rows by data file and place, and the data files that they touch, of which there are no more than the table has."""
        folder = f"deletes/{uuid.uuid4().hex}"
        rows.select("__file", "__place").write.parquet(f"{self.path}/{folder}")
        names = self._list(folder)
        if not names:
            return []
        gone = self.spark.read.schema("__file string, __place long").parquet(f"{self.path}/{folder}")
        touched = gone.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.collect_set("__file").alias("of")).collect()
        return [{"name": f"{folder}/{r.name}", "of": sorted(r.of)} for r in touched]

    def _once(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """rows, written once and read from there, so that what they depend on is evaluated once; and the folder."""
        folder = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder), folder

    def insert(self, rows: DataFrame) -> int:
        """Add rows; missing columns get their defaults. Returns the new version."""
        m = self.manifest()
        return self._commit(m["version"], m | {"files": m["files"] + self._write(self._checked(rows, m), m)})

    def delete(self, condition: Column | str) -> int:
        m = self.manifest()
        hit = self._rows(m).where(condition)
        return self._commit(m["version"], m | {"deletes": m["deletes"] + self._deletes(hit)})

    def update(self, condition: Column | str, values: dict[str, Column]) -> int:
        m = self.manifest()
        hit, staged = self._once(self._rows(m).where(condition))
        changed = hit.select(*[values.get(c["name"], F.col(c["name"])).alias(c["name"]) for c in m["columns"]])
        files, deletes = self._write(self._checked(changed, m), m), self._deletes(hit)
        self._fs.delete(self._path(staged), True)
        return self._commit(m["version"], m | {"files": m["files"] + files, "deletes": m["deletes"] + deletes})

    def merge(self, source: DataFrame, on: list[str], update: dict[str, Column] | None = None, insert: bool = True, delete_when: Column | None = None) -> int:
        """MERGE by equality on columns; values and conditions may name the source's columns as s_<name>. Fails if two source rows meet one row."""
        m = self.manifest()
        s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
        if not s.groupBy(*[f"s_{k}" for k in on]).count().where("count > 1").where(" AND ".join(f"s_{k} IS NOT NULL" for k in on)).join(self._rows(m).select(*[F.col(k).alias(f"s_{k}") for k in on]), [f"s_{k}" for k in on], "left_semi").isEmpty():
            raise Violation("MERGE command cannot affect row a second time")
        condition = [F.col(k) == F.col(f"s_{k}") for k in on]
        met = self._rows(m).join(s, condition)
        gone = met.where(delete_when) if delete_when is not None else met.limit(0)
        kept = met.where(~F.coalesce(delete_when, F.lit(False))) if delete_when is not None else met
        names = [c["name"] for c in m["columns"]]
        new = kept.select(*[(update or {}).get(n, F.col(n)).alias(n) for n in names]) if update else None
        touched = kept.select("__file", "__place").unionByName(gone.select("__file", "__place")) if update else gone
        files = self._write(self._checked(new, m), m) if new is not None else []
        if insert:
            fresh = s.join(self._rows(m).select(*on), condition, "left_anti").select(*[F.col(c).alias(c[2:]) for c in s.columns])
            files = files + self._write(self._checked(fresh.select(*[c for c in fresh.columns if c in names]), m), m)
        return self._commit(m["version"], m | {"files": m["files"] + files, "deletes": m["deletes"] + self._deletes(touched)})

    def truncate(self) -> int:
        m = self.manifest()
        return self._commit(m["version"], m | {"files": [], "deletes": []})

    def compact(self, order_by: list[str] | None = None) -> int:
        """Rewrite the rows without deleted ones (VACUUM FULL); with order_by, globally sorted (CLUSTER)."""
        m = self.manifest()
        rows = self.read(m["version"])
        rows = rows.orderBy(*order_by) if order_by else rows
        return self._commit(m["version"], m | {"files": self._write(rows, m), "deletes": []})

    # schema changes

    def _columns(self, change: Callable[[dict, list[dict]], list[dict]]) -> int:
        m = self.manifest()
        return self._commit(m["version"], m | {"columns": change(m, [dict(c) for c in m["columns"]]), "next_id": m["next_id"] + 1})

    def add_column(self, name: str, kind: DataType, default: object = None) -> int:
        return self._columns(lambda m, cs: [*cs, {"id": m["next_id"], "name": name, "type": kind.json(), "nullable": True, "default": default, "stored": f"c{m['next_id']}"}])

    def drop_column(self, name: str) -> int:
        return self._columns(lambda m, cs: [c for c in cs if c["name"] != name])

    def rename_column(self, old: str, new: str) -> int:
        return self._columns(lambda m, cs: [c | ({"name": new} if c["name"] == old else {}) for c in cs])

    def retype_column(self, name: str, kind: DataType) -> int:
        """A type that the old one casts to; files keep the old type and are cast when read."""
        return self._columns(lambda m, cs: [c | ({"type": kind.json()} if c["name"] == name else {}) for c in cs])


def _type(text: str) -> DataType:
    from pyspark.sql.types import _parse_datatype_json_string

    return _parse_datatype_json_string(text)

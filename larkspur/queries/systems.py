"""Vectors, geometry, snapshot tables, Arrow, plans and streams."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from larkspur.functions import geometry, vectors
from larkspur.functions.geometry import write_point, write_polygon
from larkspur.plans import explain
from larkspur.queries.registry import query
from larkspur.session import shared_dir, table
from larkspur.sources import arrow
from larkspur.sources.snapshots import SnapshotTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# vectors

PAIR = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) a, (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0) b"


def _distances(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return rows.join(F.broadcast(first)).select("vec_id", F.round(vectors.DISTANCES[name](F.col("embedding"), F.col("q")), 6).alias("d"))


def _vector(name: str, oracle: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _distances(spark, sf_dir, name)

    run.__name__ = f"vector_{name}"
    return query(f"SELECT vec_id, round({oracle}, 6) AS d FROM {PAIR}")(run)


_vector("l2", "list_distance(e, q)")
_vector("l2_squared", "list_distance(e, q) * list_distance(e, q)")
_vector("inner_product", "list_inner_product(e, q)")
_vector("negative_inner_product", "list_negative_inner_product(e, q)")
_vector("cosine", "list_cosine_distance(e, q)")
_vector("l1", "list_sum(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))")
_vector("spherical", "acos(greatest(-1.0, least(1.0, list_inner_product(e, q)))) / pi()")

TOP = "SELECT vec_id, round(list_distance(e, q), 6) AS d FROM {0} ORDER BY list_distance(e, q), vec_id LIMIT 10"


@query(TOP.format(PAIR))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    q = rows.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(rows, "embedding", q, 10, "l2", "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


@query(TOP.format(PAIR.replace("FROM embeddings)", "FROM embeddings WHERE label = 2)", 1)))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    q = rows.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(rows.where("label = 2"), "embedding", q, 10, "l2", "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


# geometry: each nation has a square of side 2 + key % 3 at (key * 1.5, key % 5)

X0, Y0, SIDE = "n_nationkey * 1.5", "n_nationkey % 5", "2 + n_nationkey % 3"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with g, a square, p, its centre, and the box of the square."""

    @F.pandas_udf(BinaryType())
    def square(x, y, s):
        import pandas as pd

        return pd.Series([write_polygon([[(a, b), (a + c, b), (a + c, b + c), (a, b + c), (a, b)]]) for a, b, c in zip(x, y, s, strict=True)])

    @F.pandas_udf(BinaryType())
    def centre(x, y, s):
        import pandas as pd

        return pd.Series([write_point(a + c / 2, b + c / 2, 4326) for a, b, c in zip(x, y, s, strict=True)])

    corner = [F.expr(f"CAST({e} AS DOUBLE)") for e in (X0, Y0, SIDE)]
    return table(spark, sf_dir, "nation").select("n_nationkey", square(*corner).alias("g"), centre(*corner).alias("p")).withColumn("box", geometry.box("g"))


BOXES = f"(SELECT n_nationkey AS k, CAST({X0} AS DOUBLE) AS x0, CAST({Y0} AS DOUBLE) AS y0, CAST({X0} AS DOUBLE) + {SIDE} AS x1, CAST({Y0} AS DOUBLE) + {SIDE} AS y1 FROM nation)"
OP_SQL = {
    "overlaps": "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1", "same": "a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1",
    "contains": "a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1", "within": "b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1",
    "left": "a.x1 < b.x0", "overleft": "a.x1 <= b.x1", "right": "a.x0 > b.x1", "overright": "a.x0 >= b.x0", "below": "a.y1 < b.y0", "overbelow": "a.y1 <= b.y1", "above": "a.y0 > b.y1", "overabove": "a.y0 >= b.y0",
}
EXACT_SQL = {
    "intersects": OP_SQL["overlaps"], "disjoint": f"NOT ({OP_SQL['overlaps']})",
    "touches": f"({OP_SQL['overlaps']}) AND NOT (a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)",
    "contains": OP_SQL["contains"], "covers": OP_SQL["contains"], "within": OP_SQL["within"], "coveredby": OP_SQL["within"], "equals": OP_SQL["same"],
    "containsproperly": "a.x0 < b.x0 AND a.y0 < b.y0 AND a.x1 > b.x1 AND a.y1 > b.y1",
    "overlaps": f"(a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) AND NOT ({OP_SQL['contains']}) AND NOT ({OP_SQL['within']})", "crosses": "false",
}


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = places(spark, sf_dir)
    return rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]), rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])


@query(f"SELECT a.k AS ka, b.k AS kb, {', '.join(f'({c}) AS {n}_' for n, c in OP_SQL.items())} FROM {BOXES} a, {BOXES} b")
def geo_box_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = pairs(spark, sf_dir)
    both = a.crossJoin(F.broadcast(b))  # 25 rows each: every pair is the question
    return both.select(F.col("a_n_nationkey").alias("ka"), F.col("b_n_nationkey").alias("kb"), *[op(F.col("a_box"), F.col("b_box")).alias(f"{n}_") for n, op in geometry.BOX_OPS.items()])


@query(f"SELECT n_nationkey, CAST({X0} AS DOUBLE) + ({SIDE}) / 2e0 AS x, CAST({Y0} AS DOUBLE) + ({SIDE}) / 2e0 AS y, 4326 AS srid FROM nation")
def geo_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("n_nationkey", geometry.st_x("p").alias("x"), geometry.st_y("p").alias("y"), geometry.st_srid("p").alias("srid"))


@query(f"SELECT a.k AS ka, b.k AS kb, {', '.join(f'({c}) AS {n}_' for n, c in EXACT_SQL.items())} FROM {BOXES} a, {BOXES} b")
def geo_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = pairs(spark, sf_dir)
    both = a.crossJoin(F.broadcast(b))
    return both.select(F.col("a_n_nationkey").alias("ka"), F.col("b_n_nationkey").alias("kb"), *[geometry.st(n, F.col("a_g"), F.col("b_g"), F.col("a_box"), F.col("b_box")).alias(f"{n}_") for n in EXACT_SQL])


# snapshot tables

ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def loaded(spark: SparkSession, sf_dir: str, **options) -> SnapshotTable:
    rows = table(spark, sf_dir, "orders").select(*ORDERS)
    t = SnapshotTable.create(spark, fresh(spark, "orders"), rows.schema, **options)
    t.insert(rows)
    return t


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).read()


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loaded(spark, sf_dir)
    t.update("o_orderstatus = 'P'", {"o_totalprice": F.col("o_totalprice") * 2})
    return t.read()


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_totalprice < 100000)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loaded(spark, sf_dir)
    t.delete("o_totalprice < 100000")
    return t.read()


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT (o_orderkey % 10 = 0 AND o_orderstatus = 'F')
  UNION ALL SELECT -o_orderkey, 'N', 1.0 FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey > 0""")  # fmt: skip
def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loaded(spark, sf_dir)
    some = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    source = some.select("o_orderkey", F.lit("M").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice")).unionAll(some.where("o_orderkey > 0").select(-F.col("o_orderkey"), F.lit("N"), F.lit(1.0)))
    t.merge(source, ["o_orderkey"], update={"o_totalprice": F.col("s_o_totalprice")}, delete_when=F.col("o_orderstatus") == "F")
    return t.read()


@query("SELECT count(*) AS before_, CAST(0 AS BIGINT) AS after_ FROM orders")
def dml_truncate_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loaded(spark, sf_dir)
    version = t.manifest()["version"]
    t.truncate()
    return t.read(version).agg(F.count("*").alias("before_")).join(F.broadcast(t.read().agg(F.count("*").alias("after_"))))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def dml_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loaded(spark, sf_dir)
    t.delete("o_orderkey % 3 = 0")
    t.compact(["o_orderkey"])
    assert not t.manifest()["deletes"]
    return t.read()


@query("SELECT o_orderkey, o_totalprice AS price, CAST(7 AS INTEGER) AS extra, CAST(o_orderkey AS VARCHAR) AS note FROM orders UNION ALL SELECT o_orderkey, o_totalprice, 8, 'x' FROM orders".replace("CAST(o_orderkey AS VARCHAR) AS note", "CAST(NULL AS VARCHAR) AS note"))
def dml_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import IntegerType, StringType

    rows = table(spark, sf_dir, "orders").select(*ORDERS)
    t = SnapshotTable.create(spark, fresh(spark, "orders"), rows.schema)
    t.insert(rows)
    t.rename_column("o_totalprice", "price")
    t.drop_column("o_orderstatus")
    t.add_column("extra", IntegerType(), 7)
    t.add_column("note", StringType())
    t.insert(rows.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(8).alias("extra"), F.lit("x").alias("note")))
    return t.read()


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def dml_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir, partition_by=["o_orderstatus"]).read().where("o_orderstatus = 'F'")


@query("SELECT true AS refused, count(*) AS n FROM orders WHERE o_totalprice >= 0")
def dml_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loaded(spark, sf_dir, checks={"price": "o_totalprice >= 0"})
    try:
        t.insert(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (-F.col("o_totalprice")).alias("o_totalprice")))
        refused = False
    except Exception as e:  # of Spark, or of the table
        refused = "price" in str(e)
    return t.read().agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


# Arrow


@query("SELECT c_custkey, c_name, c_acctbal, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer")
def arrow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arrow.egress(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_acctbal").cast("decimal(12,2)").alias("bal")))
    return arrow.ingest(spark, out, out.schema)


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz')) v(column_name, sql_type)")
def arrow_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = arrow.egress(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").limit(1)).schema
    return spark.createDataFrame([(f.name, f.metadata[b"sql_type"].decode()) for f in schema], "column_name string, sql_type string")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 33)")
def arrow_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return arrow.execute_many(spark, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = :k", pa.table({"k": [1, 5, 33]}))


@query("SELECT count(*) AS n, count(*) AS again FROM lineitem WHERE l_orderkey < 50")
def condition_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.condcache import ConditionCache

    path = fresh(spark, "sorted")
    table(spark, sf_dir, "lineitem").select("l_orderkey").repartitionByRange(4, "l_orderkey").write.parquet(path)
    cache = ConditionCache(spark)
    first = cache.read(path, "l_orderkey < 50").agg(F.count("*").alias("n"))
    second = cache.read(path, "l_orderkey < 50").agg(F.count("*").alias("again"))
    assert cache.skipped(path, "l_orderkey < 50") == 3
    return first.join(F.broadcast(second))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def exchange_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redistribution by key: the aggregation above needs no other exchange."""
    out = table(spark, sf_dir, "lineitem").select("l_suppkey").repartition("l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    return out


# plans


@query("SELECT true AS codegen, true AS pushed, true AS refused")
def explain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    plan = orders.where("o_orderkey < 100").groupBy("o_orderstatus").count()
    # under adaptive execution nodes are fused once they run
    codegen = any(r.node in ("HashAggregate", "Filter") for r in explain.reasons(explain.forced(plan)).collect())
    pushed = any("o_orderkey" in p for p in explain.pushed(plan))
    try:
        explain.forced(orders.join(table(spark, sf_dir, "nation"), F.col("o_custkey") < F.col("n_nationkey")))
        refused = False
    except explain.Refused:
        refused = True
    return spark.createDataFrame([(codegen, pushed, refused)], "codegen boolean, pushed boolean, refused boolean")


@query("SELECT name, 'check' AS contract FROM (VALUES ('vector_l2'), ('vector_l2_squared'), ('vector_inner_product'), ('vector_negative_inner_product'), ('vector_cosine'), ('vector_l1'), ('vector_spherical')) v(name)")
def declared_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.functions import packs

    return packs.declared(spark)


@query("SELECT n_regionkey, CAST(sum(n_nationkey * 2) AS BIGINT) AS doubled FROM nation GROUP BY n_regionkey")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL function, called by name."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION larkspur_twice(x INT) RETURNS INT RETURN x * 2")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sum(F.expr("larkspur_twice(n_nationkey)")).alias("doubled"))


# streams (an addition)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.streaming.events import windowed

    return windowed(table(spark, sf_dir, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.streaming.events import sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")

"""Joins, aggregates, windows, sorts, set operations, subqueries and benchmark shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import numeric
from larkspur.operators import aggregates, joins, topk, windows
from larkspur.queries.registry import query, text
from larkspur.session import table

# joins

text("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
text("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
text("right_join", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
text("full_join", "SELECT a.s_suppkey AS sk, b.c_custkey AS ck FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey AND a.s_nationkey = b.c_nationkey")
text("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
text("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
text("multi_key_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10")
text("null_keys_join", "SELECT a.id AS ia, b.id AS ib FROM (VALUES (1, 1), (2, NULL), (3, 3)) AS a(id, k) LEFT JOIN (VALUES (1, 1), (2, NULL), (3, 4)) AS b(id, k) ON a.k = b.k")
text("float_keys_join", "SELECT a.id AS ia, b.id AS ib FROM (VALUES (1, 0.0e0), (2, CAST('NaN' AS DOUBLE)), (3, 1.5e0)) AS a(id, k) JOIN (VALUES (1, -0.0e0), (2, CAST('NaN' AS DOUBLE)), (3, 1.5e0)) AS b(id, k) ON a.k = b.k")
text("cross_width_join", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON CAST(n_nationkey AS BIGINT) = c_custkey")
text("residual_join", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 45")
text("residual_left_join", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49")
text("theta_join", "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a JOIN nation b ON a.r_regionkey < b.n_nationkey")
text("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
text("lateral_join", "SELECT c_custkey, t.top_price FROM customer, LATERAL (SELECT max(o_totalprice) AS top_price FROM orders WHERE o_custkey = c_custkey) t")
text("self_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
text("expression_keys_join", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey + 1 = c_custkey AND upper(o_orderstatus) = substr(upper(c_mktsegment), 1, 1)")
text("broadcast_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
text("using_join", "SELECT n_nationkey, n_name FROM nation JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) USING (n_nationkey)")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def not_in_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_in(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_totalprice > 100000"), "o_custkey")


@query("SELECT c_nationkey, n_customers, n_suppliers FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON c_nationkey IS NOT DISTINCT FROM s_nationkey")
def aggregate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return joins.join_aggregates(a, b, ["c_nationkey"])


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48")
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return joins.salted(left, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"], 4).select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT e.event_id, v.value AS last_view FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON e.user_id = v.user_id AND e.ts >= v.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof(events.select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", ["value"]).select("event_id", F.col("value").alias("last_view"))


@query("SELECT o_orderkey, band FROM orders JOIN (SELECT CAST(i AS BIGINT) AS band, i * 50000.0 AS low, (i + 1) * 50000.0 AS high FROM range(0, 10) t(i)) ON o_totalprice >= low AND o_totalprice < high")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 50000.0).alias("low"), ((F.col("id") + 1) * 50000.0).alias("high"))
    return joins.in_range(table(spark, sf_dir, "orders"), bands, "o_totalprice", "low", "high", 50000.0).select("o_orderkey", "band")


# aggregates

MONEY = "sum_money({0})"
text("plain_aggregate", f"SELECT count(*) AS n, count(o_custkey) AS nc, {MONEY.format('o_totalprice')} AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
text("aggregate_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_tax) AS m FROM lineitem WHERE l_orderkey < 0")
text("hash_group", f"SELECT l_suppkey, l_returnflag, count(*) AS n, {MONEY.format('l_quantity')} AS q FROM lineitem GROUP BY l_suppkey, l_returnflag")
text("group_expression", "SELECT upper(coalesce(c_mktsegment, 'none')) AS seg, count(*) AS n FROM customer GROUP BY upper(coalesce(c_mktsegment, 'none'))")
text("group_nulls", "SELECT k, count(*) AS n, count(x) AS nx, CAST(sum(x) AS BIGINT) AS s FROM (VALUES (1, 1), (NULL, 2), (NULL, NULL), (2, NULL)) AS v(k, x) GROUP BY k")
text("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
text("filter_clause", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_tax = 0) AS untaxed FROM lineitem GROUP BY l_returnflag")
text("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag")
text("count_distinct_text", "SELECT event_type, count(DISTINCT props) AS p FROM events GROUP BY event_type")

text("bool_aggregates", "SELECT l_returnflag, bool_and(l_quantity > 0) AS all_, bool_or(l_quantity > 49) AS some_, every(l_tax >= 0) AS every_ FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, bool_and(l_quantity > 0) AS all_, bool_or(l_quantity > 49) AS some_, bool_and(l_tax >= 0) AS every_ FROM lineitem GROUP BY l_returnflag")
text("var_stddev", "SELECT l_returnflag, round(variance(l_quantity), 4) AS v, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp, round(stddev(l_quantity), 4) AS s, round(stddev_samp(l_quantity), 4) AS ss, round(stddev_pop(l_quantity), 4) AS sp FROM lineitem GROUP BY l_returnflag")
text("statistics_aggregates", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs FROM lineitem GROUP BY l_returnflag")
text("minmax_text", "SELECT c_nationkey, min(c_name) AS low, max(c_mktsegment) AS high FROM customer GROUP BY c_nationkey")
text("minmax_dates", "SELECT event_type, min(ts) AS first_, max(ts) AS last_, max(CAST(ts AS DATE)) AS day_ FROM events GROUP BY event_type")
text("avg_types", "SELECT l_returnflag, CAST(sum(l_linenumber) AS DOUBLE) / count(l_linenumber) AS a, avg(l_linenumber) AS b FROM lineitem GROUP BY l_returnflag")
text("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
text("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
text("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
text("ordered_set", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1 FROM lineitem GROUP BY l_returnflag")
text("mode_aggregate", "SELECT event_type, count(*) AS n, mode() WITHIN GROUP (ORDER BY user_id) AS most FROM events GROUP BY event_type",
     "SELECT event_type, sum(c)::BIGINT AS n, arg_max(user_id, (c, -user_id)) AS most FROM (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY ALL) GROUP BY event_type")
text("string_agg", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
text("array_agg", "SELECT n_regionkey, array_sort(array_agg(n_nationkey)) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(array_agg(n_nationkey)) AS keys FROM nation GROUP BY n_regionkey")
text("json_agg", "SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
text("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
text("functional_dependency", "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
text("aggregate_topn", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")


@query("SELECT CAST(sum(CAST(l_orderkey AS HUGEINT) * 100000000000) AS DECIMAL(38,0)) AS wide FROM lineitem")
def sum_int8_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(numeric.sum_wide(F.col("l_orderkey") * 100000000000).cast("decimal(38,0)").alias("wide"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber + 7) AS DECIMAL(38,0)) AS s FROM lineitem GROUP BY l_returnflag")
def sum_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregates.sum_offset(F.col("l_linenumber"), 7).cast("decimal(38,0)").alias("s"))


@query("SELECT l_linenumber, l_linenumber - 1 AS k1, l_linenumber * 2 AS k2, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_linenumber - 1, l_linenumber * 2")
def implied_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    return aggregates.implied_keys(table(spark, sf_dir, "lineitem"), "l_linenumber", {"k1": k - 1, "k2": k * 2}, F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, max(l_quantity) AS m, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def distinct_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.split_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", F.count("*").alias("n"), F.max("l_quantity").alias("m"), name="suppliers")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey LIMIT 5)")
def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").count().limit(5).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS DECIMAL(38,0)) AS s, CAST(round(avg(l_linenumber), 9) AS DOUBLE) AS a, CAST(round(avg(l_partkey), 5) AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag")
def avg_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = lambda c, digits: F.round(aggregates.avg_numeric(F.col(c)).cast("double"), digits)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(numeric.sum_wide(F.col("l_linenumber")).cast("decimal(38,0)").alias("s"), short("l_linenumber", 9).alias("a"), short("l_partkey", 5).alias("p"))


@query("SELECT l_linestatus, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def multi_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return aggregates.split_distincts(rows, ["l_linestatus"], {"s": ("l_suppkey", F.count), "p": ("l_partkey", F.count), "d": ("l_linenumber", F.sum)}, F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(user_id % 12) AS INTEGER) AS months, CAST(sum(user_id % 30) AS INTEGER) AS days, CAST(sum(user_id) AS BIGINT) AS micros FROM events GROUP BY event_type")
def interval_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.functions.datetime import interval

    u = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(aggregates.interval_sum(interval(u % 12, u % 30, u)).alias("i")).select("event_type", "i.*")


# windows

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey{0})"
text("row_number", f"SELECT o_orderkey, CAST(row_number() {W.format('')} AS BIGINT) AS rn FROM orders")
text("rank_family", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, percent_rank() OVER w AS p, cume_dist() OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)")
text("ntile", f"SELECT o_orderkey, CAST(ntile(4) {W.format('')} AS BIGINT) AS q FROM orders")
text("lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {W.format('')} AS prev, lead(o_totalprice, 2, 0.0e0) {W.format('')} AS next2 FROM orders")
text("first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) {W.format('')} AS f, last_value(o_orderkey) {W.format('')} AS l, nth_value(o_orderkey, 2) {W.format('')} AS n2 FROM orders")
text("rows_frame", f"SELECT o_orderkey, max(o_totalprice) {W.format(' ROWS BETWEEN 2 PRECEDING AND CURRENT ROW')} AS m3, count(*) {W.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING')} AS c FROM orders")
text("range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_partkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lineitem")
text("global_window", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS rn, count(*) OVER () AS n FROM nation")
text("window_aggregates", "SELECT c_custkey, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer")
text("window_over_group", "SELECT c_nationkey, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) t")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem")
def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.groups_frame(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.col("l_quantity").asc_nulls_last()], 1, 1, near=F.count("*")).select("l_orderkey", "l_linenumber", "near")


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM lineitem")
def exclude_current_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", windows.exclude_current("sum", "l_linenumber", w).cast("bigint").alias("others"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS BIGINT) AS upto FROM lineitem")
def exclude_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.exclude_ties(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_linenumber", "upto").select("l_orderkey", "l_linenumber", F.col("upto").cast("bigint").alias("upto"))


# sorts

text("order_nulls", "SELECT id, x FROM (VALUES (1, 3), (2, NULL), (3, 1)) AS v(id, x) ORDER BY x LIMIT 2")
text("order_nulls_desc", "SELECT id, x FROM (VALUES (1, 3), (2, NULL), (3, 1)) AS v(id, x) ORDER BY x DESC LIMIT 2", "SELECT id, x FROM (VALUES (1, 3), (2, NULL), (3, 1)) AS v(id, x) ORDER BY x DESC NULLS FIRST LIMIT 2")
text("order_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice, o_orderkey")
text("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
text("topk_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
text("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
text("order_hidden_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey")
text("order_expression", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal), c_custkey")
text("sort_over_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey")
text("with_ties_sql", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC FETCH FIRST 5 ROWS WITH TIES", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC) <= 5")
text("distinct_on_sql", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC) <= 5")
def with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.with_ties(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 5, "-l_quantity")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT * FROM pages ORDER BY length(url) DESC, page_id LIMIT 10")
def topk_late_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("len", F.length("url"))
    return topk.late_columns(pages, "page_id", 10, "-len", "page_id").drop("len")


# set operations, CTEs, subqueries

text("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
text("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
text("except_distinct", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
text("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
text("cte", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b")
text("recursive_cte", "WITH RECURSIVE t(i, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM t WHERE i < 15) SELECT i, f FROM t")
text("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
text("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
text("exists_subquery", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
text("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
text("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
text("subquery_in_select", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
text("append_partitions", "SELECT * FROM (SELECT o_orderkey, 'F' AS part_ FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'O' FROM orders WHERE o_orderstatus = 'O') t")


text("tablesample_sql", "SELECT (SELECT count(*) FROM lineitem TABLESAMPLE (100 PERCENT)) AS every, (SELECT count(*) FROM lineitem TABLESAMPLE (50 PERCENT) REPEATABLE (3)) BETWEEN 0.4 * count(*) AND 0.6 * count(*) AS half FROM lineitem", "SELECT count(*) AS every, true AS half FROM lineitem")


@query("SELECT true AS half, bool_and(l_quantity > 0) AS fine FROM lineitem")
def tablesample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TABLESAMPLE: a sampling operator, whose rows differ by seed; only facts that any sample shares are returned."""
    return table(spark, sf_dir, "lineitem").sample(0.5, seed=1).agg((F.count("*") / F.lit(table(spark, sf_dir, "lineitem").count())).between(0.4, 0.6).alias("half"), F.bool_and(F.col("l_quantity") > 0).alias("fine"))


# benchmark shapes

REVENUE = "sum_revenue()"
# the columns are counted in cents once, below the aggregation; charges have six decimals
text("tpch_q1", """SELECT l_returnflag, l_linestatus, sum_int(q, 100) AS sum_qty, sum_int(p, 100) AS sum_base_price, sum_big(p * (100 - d), 10000) AS sum_disc_price, sum_big(p * (100 - d) * (100 + x), 1000000) AS sum_charge,
  sum_int(q, 100) / count(*) AS avg_qty, sum_int(p, 100) / count(*) AS avg_price, sum_int(d, 100) / count(*) AS avg_disc, count(*) AS count_order
  FROM (SELECT l_returnflag, l_linestatus, in_cents(l_quantity) AS q, in_cents(l_extendedprice) AS p, in_cents(l_discount) AS d, in_cents(l_tax) AS x FROM lineitem WHERE l_shipdate <= timestamp '2001-09-02 00:00:00') t
  GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")  # fmt: skip
text("tpch_q3", f"SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < timestamp '1998-03-15 00:00:00' AND l_shipdate > timestamp '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
text("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= timestamp '1997-07-01 00:00:00' AND o_orderdate < timestamp '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority ORDER BY o_orderpriority")
text("tpch_q5", f"SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= timestamp '1996-01-01 00:00:00' AND o_orderdate < timestamp '1997-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC")
text("tpch_q6", "SELECT sum_product(l_extendedprice, l_discount) AS revenue FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01 00:00:00' AND l_shipdate < timestamp '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
text("tpch_q10", f"SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= timestamp '1997-10-01 00:00:00' AND o_orderdate < timestamp '1998-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
text("tpch_q12", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= timestamp '1996-01-01 00:00:00' GROUP BY l_linestatus")
text("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) t GROUP BY c_count")
text("tpch_q14", "SELECT 100e0 * sum_revenue(p_type LIKE 'PROMO%') / sum_revenue() AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= timestamp '1997-09-01 00:00:00' AND l_shipdate < timestamp '1997-10-01 00:00:00'")
text("tpch_q17", "SELECT sum_money(l_extendedprice) / 7e0 AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)")
text("tpch_q18", f"SELECT c_custkey, o_orderkey, o_totalprice, q FROM (SELECT l_orderkey, {MONEY.format('l_quantity')} AS q FROM lineitem GROUP BY l_orderkey) t JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE q > 200 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
text("tpch_q19", f"SELECT {REVENUE} AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 10 AND l_quantity < 11) OR (p_size BETWEEN 20 AND 30 AND l_quantity > 40))")
text("tpch_q22", f"SELECT c_nationkey, count(*) AS n, {MONEY.format('c_acctbal')} AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey")
text("clickbench_count", "SELECT event_type, count(*) AS c, count(DISTINCT user_id) AS u FROM events GROUP BY event_type")
text("clickbench_topk_users", "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10")
text("clickbench_like", "SELECT count(*) AS n FROM events WHERE props LIKE '%\"k\": 2%'")
text("clickbench_minute", "SELECT date_trunc('minute', ts) AS m, count(*) AS c FROM events GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 20")
text("clickbench_wide_sums", "SELECT " + ", ".join(f"CAST(sum(user_id + {i}) AS BIGINT) AS s{i}" for i in range(30)) + " FROM events")
text("clickbench_user_type", "SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10")
text("clickbench_case_group", "SELECT CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS band, extract(hour FROM ts) AS h, count(*) AS c FROM events GROUP BY 1, 2", "SELECT CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS band, CAST(extract(hour FROM ts) AS INTEGER) AS h, count(*) AS c FROM events GROUP BY 1, 2")

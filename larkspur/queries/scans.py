"""Scans, predicates, arithmetic, casts, text and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import datetime as dt
from larkspur.functions import nested, numeric
from larkspur.functions import text as tx
from larkspur.queries.registry import query, text
from larkspur.session import shared_dir, table
from larkspur.sources import parquet

text("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'A'")
text("scan_count", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate < timestamp '1998-01-01 00:00:00'")
text("scan_pruned", "SELECT l_suppkey, l_tax FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900 AND l_tax > 0.03")
text("scan_in_order_conjunct", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
text("values_scan", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(x, y) WHERE x > 1")
text("cte_scan", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
text("function_scan", "SELECT CAST(g AS BIGINT) AS g, CAST(g * g AS BIGINT) AS sq FROM (SELECT explode(sequence(1, 50)) AS g) t", "SELECT CAST(g AS BIGINT) AS g, CAST(g * g AS BIGINT) AS sq FROM generate_series(1, 50) t(g)")
text("scan_nested_array", "SELECT vec_id, cardinality(embedding) AS dims, embedding[0] AS first_value FROM embeddings WHERE label = 1", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, embedding[1] AS first_value FROM embeddings WHERE label = 1")


@query("SELECT count(*) AS n, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders")
def scan_minmax_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.stats_aggregate(spark, f"{sf_dir}/orders.parquet", "o_orderkey")


@query("SELECT count(*) AS n, count(DISTINCT r_name) AS names FROM region")
def external_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read(spark, f"{sf_dir}/region.parquet").agg(F.count("*").alias("n"), F.countDistinct("r_name").alias("names"))


@query("SELECT r_regionkey AS R_REGIONKEY, r_name AS R_NAME, CAST(NULL AS VARCHAR) AS r_comment FROM region")
def external_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import IntegerType, StringType, StructType

    return parquet.read(spark, f"{sf_dir}/region.parquet", StructType().add("R_REGIONKEY", IntegerType()).add("R_NAME", StringType()).add("r_comment", StringType()))


@query("SELECT count(*) AS rows_in_files FROM lineitem")
def parquet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.files(spark, f"{sf_dir}/lineitem.parquet").agg(F.sum("rows").alias("rows_in_files"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(o_orderkey) AS BIGINT) AS n_nulls FROM orders")
def parquet_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.row_groups(spark, f"{sf_dir}/orders.parquet").where("column_name = 'o_orderkey'").agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("n_nulls"))


@query("SELECT column_name FROM (DESCRIBE SELECT * FROM supplier)")
def parquet_file_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.file_schema(spark, f"{sf_dir}/supplier.parquet").select("column_name").distinct()


@query("SELECT n_nationkey, CAST(row_number() OVER () - 1 AS BIGINT) AS row_index, true AS own_file FROM nation")
def system_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "_metadata.row_index", "_metadata.file_path")
    return rows.select("n_nationkey", "row_index", F.col("file_path").contains("nation.parquet").alias("own_file"))


# predicates

text("cmp_ints", "SELECT l_orderkey, l_linenumber, l_partkey < l_suppkey AS lt, l_partkey >= 50 AS ge, l_linenumber <> 3 AS ne FROM lineitem")
text("cmp_float", "SELECT l_orderkey, l_linenumber, l_discount > l_tax AS gt, l_quantity = 5 AS eq FROM lineitem")
text("cmp_float_special", "SELECT id, a = b AS eq, a < b AS lt, a > b AS gt FROM (VALUES (1, CAST('NaN' AS DOUBLE), CAST('NaN' AS DOUBLE)), (2, CAST('NaN' AS DOUBLE), 1e300), (3, -0.0, 0.0), (4, CAST('Infinity' AS DOUBLE), 1e0), (5, NULL, 1e0)) AS v(id, a, b)")
text("cmp_date_ts", "SELECT o_orderkey, o_orderdate >= timestamp '1996-01-01 00:00:00' AS since, CAST(o_orderdate AS DATE) = date '1996-01-02' AS that_day FROM orders")
text("cmp_text", "SELECT c_custkey, c_mktsegment < 'C' AS lt, c_name >= 'Customer#000000500' AS ge FROM customer")
text("bool_3vl", "SELECT id, a AND b AS both_, a OR b AS either, NOT a AS negated FROM (VALUES (1, true, NULL), (2, false, NULL), (3, NULL, NULL), (4, true, false), (5, NULL, true)) AS v(id, a, b)")
text("is_null", "SELECT id, x IS NULL AS n, x IS NOT NULL AS nn FROM (VALUES (1, 1), (2, NULL)) AS v(id, x)")
text("is_true_false_unknown", "SELECT id, b IS TRUE AS t, b IS NOT TRUE AS nt, b IS FALSE AS f, b IS NOT FALSE AS nf, b IS UNKNOWN AS u, b IS NOT UNKNOWN AS nu FROM (VALUES (1, true), (2, false), (3, NULL)) AS v(id, b)", "SELECT id, b IS TRUE AS t, b IS NOT TRUE AS nt, b IS FALSE AS f, b IS NOT FALSE AS nf, b IS NULL AS u, b IS NOT NULL AS nu FROM (VALUES (1, true), (2, false), (3, NULL)) AS v(id, b)")
text("is_distinct_from", "SELECT id, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS nd FROM (VALUES (1, 1, 1), (2, 1, 2), (3, NULL, 1), (4, NULL, NULL)) AS v(id, a, b)")
text("in_list", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS is_in, o_orderkey NOT IN (1, 2, 3, 4) AS not_in FROM orders")
text("not_in_null", "SELECT id, x IN (1, NULL) AS i, x NOT IN (1, NULL) AS ni FROM (VALUES (1, 1), (2, 2), (3, NULL)) AS v(id, x)")
text("any_all_array", "SELECT o_orderkey, o_orderkey % 7 = ANY (ARRAY[1, 3]) AS in_any, o_orderkey % 7 > ALL (ARRAY[1, 3]) AS over_all, o_orderkey % 7 <> ALL (ARRAY[1, NULL]) AS not_all FROM orders",
     "SELECT o_orderkey, o_orderkey % 7 IN (1, 3) AS in_any, (o_orderkey % 7 > 1 AND o_orderkey % 7 > 3) AS over_all, (o_orderkey % 7 <> 1 AND o_orderkey % 7 <> NULL) AS not_all FROM orders")
text("between_like", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 1000 AND c_name LIKE '%5'")
text("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
text("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
text("case_guards_error", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN 100 / CAST(l_linenumber - 1 AS DOUBLE) END AS guarded FROM lineitem")
text("coalesce_nullif", "SELECT id, coalesce(a, b, 9) AS c, nullif(a, b) AS n FROM (VALUES (1, 1, 2), (2, NULL, 2), (3, NULL, NULL), (4, 3, 3)) AS v(id, a, b)")
text("greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10e0, NULL) AS g, least(l_quantity, 10e0) AS l FROM lineitem", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10.0) AS g, least(l_quantity, 10.0) AS l FROM lineitem")
text("row_field", "SELECT id, r.x AS x, r.y AS y FROM (SELECT id, named_struct('x', id * 2, 'y', 'a') AS r FROM (VALUES (1), (2)) AS v(id)) t", "SELECT id, id * 2 AS x, 'a' AS y FROM (VALUES (1), (2)) AS v(id)")
text("row_compare", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 500)")
text("shared_subexpression", "SELECT l_orderkey, l_linenumber, (l_quantity * (1 - l_discount)) + 1 AS a, (l_quantity * (1 - l_discount)) * 2 AS b FROM lineitem")


@query("SELECT vec_id, list_contains(embedding[1:3], embedding[2]) AS has_second, list_contains([1, NULL], vec_id % 3) AS three_valued FROM embeddings".replace("list_contains([1, NULL], vec_id % 3)", "CASE WHEN vec_id % 3 = 1 THEN true END"))
def any_array_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_contains(F.slice(e, 1, 3), e[1]).alias("has_second"), nested.eq_any(F.col("vec_id") % 3, F.array(F.lit(1).cast("bigint"), F.lit(None).cast("bigint"))).alias("three_valued"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.plans.dialect import sql
    from larkspur.session import with_views

    with_views(spark, sf_dir, "orders")
    return sql(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least", {"status": "F", "least": 100000.0})


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def row_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return visible.where("c_acctbal > 0").select("c_custkey", "c_acctbal")


# arithmetic and casts

text("int_arith", "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS s, l_partkey - l_suppkey AS d, l_linenumber * 3 AS m FROM lineitem")
text("float_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS disc, l_extendedprice / l_quantity AS unit, -l_tax AS neg FROM lineitem")
text("decimal_arith", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(14,4)) AS p, CAST(CAST(l_quantity AS DECIMAL(10,2)) + 1.5 AS DECIMAL(12,2)) AS s, CAST(l_quantity AS DECIMAL(10,2)) > 20.5 AS gt FROM lineitem")
text("math_functions", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS sq, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, round(exp(c_acctbal / 10000), 6) AS ex, round(ln(abs(c_acctbal) + 1), 6) AS lg, sign(c_acctbal) AS sg, round(power(c_acctbal, 2), 2) AS p2 FROM customer",
     "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS sq, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, round(exp(c_acctbal / 10000), 6) AS ex, round(ln(abs(c_acctbal) + 1), 6) AS lg, CAST(sign(c_acctbal) AS DOUBLE) AS sg, round(power(c_acctbal, 2), 2) AS p2 FROM customer")


text("int_div_mod", "SELECT l_orderkey, l_linenumber, (l_partkey - 1000) / 7 AS d, (l_partkey - 1000) % 7 AS m, CAST(-7 / 2 AS BIGINT) AS neg, l_partkey / 2 / 3 AS twice FROM lineitem",
     "SELECT l_orderkey, l_linenumber, CAST((l_partkey - 1000) // 7 AS BIGINT) AS d, (l_partkey - 1000) % 7 AS m, CAST(-3 AS BIGINT) AS neg, CAST(l_partkey // 2 // 3 AS BIGINT) AS twice FROM lineitem")


text("neg_abs", "SELECT c_custkey, -c_acctbal AS neg, abs(c_acctbal) AS pos, abs(c_nationkey - 12) AS dist FROM customer")
text("casts_narrow", "SELECT l_orderkey, CAST(l_partkey AS INT) AS i, CAST(l_linenumber AS SMALLINT) AS s, CAST(l_linenumber AS BIGINT) AS b, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_partkey AS VARCHAR(20)) AS t FROM lineitem")


text("rint_cast", "SELECT l_orderkey, l_linenumber, CAST(l_tax * 50 AS INTEGER) AS i, l_extendedprice::BIGINT AS b FROM lineitem")
text("numeric_cast", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS BIGINT) AS whole FROM orders")


@query("SELECT l_orderkey, l_linenumber, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS l FROM lineitem")
def gcd_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.gcd(a, b).alias("g"), numeric.lcm(a, b).alias("l"))


# text

text("like_eq", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#13'")
text("like_prefix", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'BUILD%'")
text("like_suffix", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%TURE'")
text("like_substring", "SELECT page_id FROM pages WHERE url LIKE '%example.net%'")
text("like_wild", "SELECT page_id FROM pages WHERE url LIKE 'http_://%/en/%'")
text("not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%BRASS%'")
text("ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%LICENSE%'")
text("length_fns", "SELECT doc_id, length(text) AS chars, char_length(text) AS chars2, octet_length(text) AS bytes FROM documents", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(char_length(text) AS INTEGER) AS chars2, CAST(octet_length(CAST(text AS BLOB)) AS INTEGER) AS bytes FROM documents".replace("CAST(octet_length(CAST(text AS BLOB)) AS INTEGER)", "CAST(strlen(text) AS INTEGER)"))
text("string_functions", "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, substr(c_name, 10, 4) AS s, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, replace(c_name, '0', '') AS r, reverse(c_mktsegment) AS rev, left(c_name, 3) AS le, right(c_name, 3) AS ri, strpos(c_name, '#') AS pos, concat(c_mktsegment, '/', c_name) AS cc, repeat('ab', 3) AS rep, md5(c_name) AS m, split_part(c_name, '#', 2) AS sp, ascii(c_name) AS asc_, starts_with(c_name, 'Cust') AS sw, trim('  x ') AS t FROM customer",
     "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, substr(c_name, 10, 4) AS s, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, replace(c_name, '0', '') AS r, reverse(c_mktsegment) AS rev, left(c_name, 3) AS le, right(c_name, 3) AS ri, CAST(strpos(c_name, '#') AS INTEGER) AS pos, concat(c_mktsegment, '/', c_name) AS cc, repeat('ab', 3) AS rep, md5(c_name) AS m, split_part(c_name, '#', 2) AS sp, ascii(c_name) AS asc_, starts_with(c_name, 'Cust') AS sw, trim('  x ') AS t FROM customer")
text("to_hex_sha", "SELECT c_custkey, to_hex(c_custkey) AS h, sha256(c_name) AS s FROM customer", "SELECT c_custkey, lower(to_hex(c_custkey)) AS h, sha256(c_name) AS s FROM customer")
text("regex_operators", "SELECT page_id, url ~ '^https' AS secure, url !~ 'example' AS other, url ~* 'EXAMPLE\\\\.NET' AS net FROM pages", "SELECT page_id, regexp_matches(url, '^https') AS secure, NOT regexp_matches(url, 'example') AS other, regexp_matches(url, 'EXAMPLE\\.NET', 'i') AS net FROM pages")


text("char_pad_compare", "SELECT c_custkey, CAST(c_mktsegment || '  ' AS CHAR(12)) = CAST(c_mktsegment AS CHAR(12)) AS eq, c_mktsegment::char(4) = 'BUIL' AS cut_, length(CAST('ab  ' AS CHAR(4))) AS n FROM customer",
     "SELECT c_custkey, rtrim(c_mktsegment) = rtrim(c_mktsegment || '  ') AS eq, rtrim(c_mktsegment[1:4]) = 'BUIL' AS cut_, CAST(2 AS INTEGER) AS n FROM customer")


text("regexp_replace_host", r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS host, count(*) AS n, CAST(sum(length(url)) AS BIGINT) AS total FROM pages GROUP BY 1")
text("regexp_replace_first", r"SELECT page_id, regexp_replace(url, '([a-z])/([a-z])', '\2<\1>') AS first_only, regexp_replace(url, '[aeiou]', '_', 'g') AS all_vowels, regexp_replace(url, '^x|t', '') AS one_of FROM pages")
text("regexp_replace_back_reference", r"SELECT page_id, regexp_replace(url, '([a-z])\1', '<\1>') AS doubled FROM pages WHERE url IS NOT NULL",
     "SELECT page_id, CASE WHEN spot = 0 THEN url ELSE url[1:spot - 1] || '<' || url[spot] || '>' || url[spot + 2:] END AS doubled FROM (SELECT *, coalesce(list_min(list_filter(range(1, length(url)), lambda i: url[i] = url[i + 1] AND url[i] >= 'a' AND url[i] <= 'z')), 0) AS spot FROM pages WHERE url IS NOT NULL)")


# dates

FIELDS = ("year", "quarter", "month", "week", "day", "doy", "hour", "minute", "dow", "isodow", "isoyear", "decade", "century", "millennium")


text("extract_fields", "SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS {f}_" for f in FIELDS) + " FROM events")


text("extract_pg_only_fields", "SELECT event_id, CAST(extract(epoch FROM ts) AS DOUBLE) AS epoch_, CAST(floor(extract(milliseconds FROM ts)) AS BIGINT) AS ms, CAST(extract(microseconds FROM ts) AS BIGINT) AS us, CAST(floor(extract(julian FROM ts)) AS BIGINT) AS jd FROM events")
text("date_part", "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS m FROM orders")


@query("SELECT event_id, " + ", ".join(f"date_trunc('{f}', ts) AS {f}_" for f in ("day", "hour", "minute", "second")) + " FROM events")
def date_trunc_day_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *[dt.date_trunc(f, F.col("ts")).alias(f"{f}_") for f in ("day", "hour", "minute", "second")])


text("date_trunc_coarse", "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{f}', o_orderdate) AS TIMESTAMP_NTZ) AS {f}_" for f in ("week", "month", "quarter", "year", "decade", "century", "millennium")) + " FROM orders",
     "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{f}', o_orderdate) AS TIMESTAMP) AS {f}_" for f in ("week", "month", "quarter", "year", "decade")) + ", " + ", ".join(f"CAST(make_date(CAST((year(o_orderdate) - 1) // {n} * {n} + 1 AS INTEGER), 1, 1) AS TIMESTAMP) AS {f}_" for f, n in (("century", 100), ("millennium", 1000))) + " FROM orders")


@query("SELECT event_id, CAST(make_timestamp(CAST(value * 1000000 AS BIGINT)) AS TIMESTAMP) AS t FROM (SELECT event_id, CAST(floor(value) AS DOUBLE) AS value FROM events)")
def to_timestamp_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dt.to_timestamp(F.floor("value").cast("double")).cast("timestamp_ntz").alias("t"))


text("date_ts_casts", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) < timestamp '1997-01-01 00:00:00' AS before_97 FROM orders")


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01') AS bin_ FROM events")
def date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dt.date_bin(900_000_000, F.col("ts")).alias("bin_"))


@query("SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 90 MINUTE AS later FROM events")
def interval_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dt.add_interval(F.col("ts"), dt.interval(F.lit(1), F.lit(3), F.lit(90 * 60_000_000))).alias("later"))


# nested and JSON

text("array_functions", "SELECT vec_id, cardinality(array_cat(ARRAY[vec_id, 2], ARRAY[label])) AS n, array_to_string(ARRAY[CAST(vec_id AS VARCHAR(20)), CAST(label AS VARCHAR(20))], '-') AS joined, array_length(embedding, 1) AS dims, array_append(ARRAY[vec_id], 7) AS longer, string_to_array(concat(label, ',', vec_id), ',') AS parts FROM embeddings",
     "SELECT vec_id, CAST(3 AS INTEGER) AS n, vec_id || '-' || label AS joined, CAST(len(embedding) AS INTEGER) AS dims, [vec_id, 7] AS longer, [CAST(label AS VARCHAR), CAST(vec_id AS VARCHAR)] AS parts FROM embeddings")
text("json_build", "SELECT c_custkey, jsonb_build_object('id', c_custkey, 'seg', c_mktsegment) AS j FROM customer", "SELECT c_custkey, CAST(json_object('id', c_custkey, 'seg', c_mktsegment) AS VARCHAR) AS j FROM customer")
text("split_and_case", "SELECT c_custkey, split_part(c_name, '#', 2) AS number, initcap(lower(c_mktsegment)) AS seg, btrim(concat('  ', c_mktsegment, ' ')) AS bare FROM customer", "SELECT c_custkey, split_part(c_name, '#', 2) AS number, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS seg, c_mktsegment AS bare FROM customer")
text("integer_average", "SELECT l_returnflag, sum(l_linenumber) / count(*) AS whole, CAST(avg(l_quantity) AS BIGINT) AS near FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS whole, CAST(avg(l_quantity) AS BIGINT) AS near FROM lineitem GROUP BY l_returnflag")
text("array_agg_ordered", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey DESC) AS keys FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey DESC) AS keys FROM orders GROUP BY o_custkey")
text("unnest_ordinality", "SELECT vec_id, CAST(pos + 1 AS BIGINT) AS place, x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 3)) t AS pos, x", "SELECT vec_id, CAST(p.i AS BIGINT) AS place, embedding[p.i] AS x FROM embeddings, (SELECT unnest([1, 2, 3]) AS i) p")
text("json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")


@query("SELECT event_id, CAST(user_id AS INTEGER) AS k_a, true AS has_a, event_type IN ('z', 'b', 'click') AS has_any, event_type = 'view' AS has_view FROM events")
def hstore_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("user_id"), F.col("event_type"), F.lit(None).cast("bigint"))
    return table(spark, sf_dir, "events").select("event_id", nested.fetch(m, "a").cast("int").alias("k_a"), nested.has_key(m, "a").alias("has_a"), nested.has_any(m, F.array(F.lit("z"), F.lit("b"), F.lit("click"))).alias("has_any"), nested.has_key(m, "view").alias("has_view"))


@query("SELECT id, list_transform(a, lambda x: CASE WHEN x = 1 THEN 9 ELSE x END) AS replaced, list_filter([CASE WHEN a[1] = 1 THEN 1 END, CASE WHEN a[2] = 1 THEN 2 END, CASE WHEN a[3] = 1 THEN 3 END], lambda i: i IS NOT NULL) AS places FROM (VALUES (1, [1, 2, 1]), (2, [3, NULL, 1])) v(id, a)")
def array_replace_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, [1, 2, 1]), (2, [3, None, 1])], "id int, a array<int>")
    return rows.select("id", nested.array_replace(F.col("a"), F.lit(1), F.lit(9)).alias("replaced"), nested.array_positions(F.col("a"), F.lit(1)).alias("places"))


@query("SELECT count(*) AS n, CAST(sum(octet_length(CAST(x AS BLOB))) AS BIGINT) AS total FROM (SELECT r_name AS x FROM region)".replace("octet_length(CAST(x AS BLOB))", "strlen(x)"))
def copy_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO and FROM: the table as CSV in a shared folder, read again."""
    import uuid

    path = f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}"
    table(spark, sf_dir, "region").write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema("r_regionkey int, r_name string").csv(path)
    return back.agg(F.count("*").alias("n"), F.sum(F.octet_length("r_name")).alias("total"))

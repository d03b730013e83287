"""One query for each construct that the engine answers, over the driver's tables, and the same in standard SQL.

Most are pairs of texts, since the engine's language is SQL; nested data and the engine's own operators use DataFrames.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.facts import collect_facts
from tessera.operators.infer import build_table
from tessera.operators.stats import stats_of
from tessera.plans.engine import QueryEngine
from tessera.plans.guard import ReadOnlyViolationError
from tessera.plans.profiler import Profiler, validate
from tessera.plans.table_text import FORMATS
from tessera.sources.json_text import dumps, loads, walk_path
from tessera.sources.records import from_column

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the tables it names; each becomes a DataFrame argument, so no view of the session is touched."""
    own = {t: read(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    return spark.sql(re.sub(rf"(?<=FROM )({'|'.join(TABLES)})\b|(?<=JOIN )({'|'.join(TABLES)})\b", lambda m: "{" + m[0] + "}", text), **own)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL; oracle: its standard form, where that differs."""
    _QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    _ORACLES[name] = oracle or text


def frame(name: str, oracle: str | None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = build
        if oracle:
            _ORACLES[name] = oracle
        return build

    return add


# ---- projection, filters, expressions

sql("select_topn_orders", "SELECT o_orderkey, o_totalprice AS price, o_orderpriority FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 20")
sql("select_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 15")
sql("filter_predicates", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_orderkey % 5 <> 0 AND l_discount >= 0.02")
sql("case_tier", "SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'high' WHEN p_retailprice > 1000 THEN 'middle' ELSE 'low' END AS tier, ROUND(p_retailprice * 2 - 1, 1) AS price FROM part")
sql("coalesce_left_join", "SELECT c.c_custkey, COALESCE(o.n, 0) AS n_orders FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
sql("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("string_functions", "SELECT p_partkey, UPPER(p_name) AS upper_name, LOWER(p_brand) AS lower_brand, CAST(LENGTH(p_type) AS BIGINT) AS n, CONTAINS(p_type, 'A') AS has_a, repeat(p_brand, 2) AS twice, p_name || '-' || p_brand AS joined FROM part")
sql("math_functions", "SELECT l_orderkey, l_linenumber, ABS(l_discount - 0.05) AS a, CAST(CEIL(l_tax * 100) AS BIGINT) AS c, CAST(FLOOR(l_quantity / 3) AS BIGINT) AS f, CAST(FLOOR(l_extendedprice / 7) AS BIGINT) AS r, try_divide(l_quantity, l_linenumber - 1) AS d, l_orderkey % 7 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, ABS(l_discount - 0.05) AS a, CAST(CEIL(l_tax * 100) AS BIGINT) AS c, CAST(FLOOR(l_quantity / 3) AS BIGINT) AS f, CAST(FLOOR(l_extendedprice / 7) AS BIGINT) AS r, l_quantity / NULLIF(l_linenumber - 1, 0) AS d, l_orderkey % 7 AS m FROM lineitem")
sql("date_functions", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(CAST(DATE_TRUNC('MONTH', o_orderdate) AS DATE) AS STRING) AS first_day FROM orders")
sql("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n")
sql("lateral_alias", "SELECT x.a AS a, x.a + 1 AS b FROM (SELECT CAST(s_suppkey * 2 AS BIGINT) AS a FROM supplier) x")
sql("select_without_from", "SELECT 1 AS one, 'a' AS letter")
sql("range_function", "SELECT i AS i, i * i AS square FROM range(100) t(i)")
sql("quoted_identifiers", "SELECT `end`.`first-name` AS name FROM (SELECT named_struct('first-name', c_name) AS `end` FROM customer)", 'SELECT c_name AS name FROM customer')

sql("regex_functions", "SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS first_word, regexp_replace(p_name, '[aeiou]', '') AS bare, p_brand RLIKE '[13]$' AS odd FROM part", "SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS first_word, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare, regexp_matches(p_brand, '[13]$') AS odd FROM part")
sql("not_in_null_safe", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_name IS NOT NULL AND NOT (n_nationkey = 3 OR n_nationkey < 2)")

# ---- aggregation

sql("agg_global", "SELECT COUNT(*) AS n, COUNT(l_tax) AS n_tax, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_discount) AS lo, MAX(l_extendedprice) AS hi, ROUND(SUM(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem")
sql("agg_group_having", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 1) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10")
sql("agg_count_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
sql("agg_filter_clause", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_totalprice > 150000) AS big, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
sql("agg_share", "SELECT o_orderstatus, ROUND(COUNT(*) * 100e0 / (SELECT COUNT(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderstatus")
for _kind, _groups in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    sql(f"agg_{_kind}", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY {_groups}")
sql("agg_group_all", "SELECT l_shipmode AS k, COUNT(*) AS n FROM (SELECT l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL ORDER BY ALL")
sql("agg_array_agg_sorted", "SELECT o_custkey, array_join(array_sort(array_agg(o_orderkey)), ',') AS keys FROM (SELECT o_custkey, CAST(o_orderkey AS STRING) AS o_orderkey FROM orders) GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys FROM (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders) GROUP BY o_custkey")
sql("agg_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, 1 AS one FROM orders) PIVOT (COUNT(one) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
sql("agg_unpivot", "SELECT k, what, v FROM (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS nation_key, s_suppkey * 2 AS twice FROM supplier) UNPIVOT (v FOR what IN (nation_key, twice))", "SELECT s_suppkey AS k, 'nation_key' AS what, CAST(s_nationkey AS BIGINT) AS v FROM supplier UNION ALL SELECT s_suppkey, 'twice', s_suppkey * 2 FROM supplier")
sql("agg_median", "SELECT l_returnflag, ROUND(median(l_quantity), 4) AS med, ROUND(percentile(l_extendedprice, 0.9), 2) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(median(l_quantity), 4) AS med, ROUND(quantile_cont(l_extendedprice, 0.9), 2) AS p90 FROM lineitem GROUP BY l_returnflag")


# 64 registers of a sketch: no exact form, so only rows are compared.
@frame("agg_approx_distinct", "SELECT DISTINCT l_returnflag, TRUE AS close FROM lineitem")
def _agg_approx_distinct(spark, d):
    """Both counts are over the distinct pairs, where a sketch ends as it does over all rows; with COUNT(DISTINCT) beside it,
    Spark would keep a sketch for each pair."""
    pairs = read(spark, d, "lineitem").select("l_returnflag", "l_partkey").distinct()
    counts = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("approximate"), F.count("l_partkey").alias("exact"))
    return counts.select("l_returnflag", F.expr("ABS(approximate - exact) <= 0.15 * exact AS close"))


sql("agg_approx_percentile", "SELECT l_returnflag, ABS(percentile_approx(l_quantity, 0.5, 1000) - MEDIAN(l_quantity)) <= 1 AS close FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, TRUE AS close FROM lineitem")
# Nulls are kept where each value is wrapped before it is gathered.
sql("agg_array_agg_nulls", "SELECT r, array_join(transform(array_sort(collect_list(named_struct('k', s_suppkey, 'v', v))), x -> x.v), ',', 'null') AS v FROM (SELECT s_nationkey % 3 AS r, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS STRING) END AS v FROM supplier) x GROUP BY r", "SELECT r, array_to_string(list(coalesce(v, 'null') ORDER BY s_suppkey), ',') AS v FROM (SELECT s_nationkey % 3 AS r, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS v FROM supplier) x GROUP BY r")
sql("divide_by_zero", "SELECT s_suppkey, try_divide(s_acctbal, s_suppkey % 3) AS q, try_divide(s_suppkey, s_suppkey % 2) AS w FROM supplier", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / (s_suppkey % 3) END AS q, CASE WHEN s_suppkey % 2 <> 0 THEN CAST(s_suppkey AS DOUBLE) / (s_suppkey % 2) END AS w FROM supplier")

# ---- joins

sql("join_inner_multi", "SELECT r.r_name, n.n_name, COUNT(*) AS n_lines, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
sql("join_derived_and_cte", "WITH t AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT o.o_orderstatus, COUNT(*) AS n, ROUND(SUM(t.q), 1) AS q FROM orders o JOIN t ON o.o_orderkey = t.l_orderkey JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey GROUP BY o.o_orderstatus")
sql("join_right", "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
sql("join_full", "SELECT n.n_nationkey, s.s_suppkey FROM nation n FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_nationkey = n.n_nationkey + 5")
sql("join_using", "SELECT k AS k, a.x AS x, b.y AS y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
sql("join_natural", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b")
sql("join_cross", "SELECT r.r_name AS a, s.r_name AS b FROM region r CROSS JOIN region s")
sql("join_self_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_semi_exists", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("join_anti_not_exists", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F')")
sql("scalar_subquery", "SELECT p_partkey, p_retailprice > (SELECT AVG(p_retailprice) FROM part) AS dear FROM part")
sql("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
# The latest order of a customer at or before a moment: both in one order by customer and time, so each row is read once
# however many orders a customer has.
sql(
    "join_asof",
    "SELECT event_id, o_orderkey FROM (SELECT event_id, side, LAST_VALUE(o_orderkey) IGNORE NULLS OVER (PARTITION BY k ORDER BY ts, side, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_orderkey FROM (SELECT user_id AS k, ts, 1 AS side, event_id, CAST(NULL AS BIGINT) AS o_orderkey FROM events UNION ALL SELECT o_custkey, o_orderdate, 0, NULL, o_orderkey FROM orders) u) x WHERE side = 1",
    "SELECT e.event_id, (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1) AS o_orderkey FROM events e",
)
sql("join_interval", "SELECT p.tier, COUNT(*) AS n FROM part t JOIN (SELECT 'low' AS tier, 0 AS a, 1000 AS b UNION ALL SELECT 'middle', 1000, 1500 UNION ALL SELECT 'high', 1500, 100000) p ON t.p_retailprice >= p.a AND t.p_retailprice < p.b GROUP BY p.tier")

# ---- windows

sql("window_rank_rownumber_ntile", "SELECT p_partkey, CAST(RANK() OVER (ORDER BY p_size NULLS LAST) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (ORDER BY p_size NULLS LAST) AS BIGINT) AS d, CAST(ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS BIGINT) AS n, CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS q FROM part")
sql("window_lag_lead", "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events")
sql("window_frames", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, ROUND(PERCENT_RANK() OVER (PARTITION BY event_type ORDER BY value, event_id), 9) AS p FROM events")
sql("window_over_aggregate", "SELECT p_brand, COUNT(*) AS n, CAST(RANK() OVER (ORDER BY COUNT(*) DESC) AS BIGINT) AS r FROM part GROUP BY p_brand")
sql("qualify_top1", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) x WHERE n = 1", "SELECT c_nationkey, c_custkey FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) = 1")
sql("topk_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT l_returnflag, l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) x WHERE n <= 3")

# ---- sets and order

sql("set_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
sql("set_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
sql("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
sql("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
sql("order_nulls_last", "SELECT k, v FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS v FROM supplier) x ORDER BY v DESC NULLS LAST, k LIMIT 7")

# ---- nested data: orders as documents, each with its customer and its lines


#: Of the lines' files, for a task that gathers them.
DEALT_BYTES = 32 << 20


def table_bytes(table: DataFrame) -> int:
    """Size of a table's files, as Spark's plan has it."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(spark: SparkSession, sf_dir: str, table: DataFrame, key: str) -> DataFrame:
    """table by key, to tasks that grow in number with the lines and not in size; few lines are left to Spark.

    A task holds several sorts of what is dealt to it. Spark's own tasks take up to the advisory size of compressed bytes each,
    and more once there are spark.sql.shuffle.partitions of them. Fewer tasks than that won't do: Spark would deal both sides
    of a join anew. Over 200 tasks, shuffle writers sort in memory, so DEALT_BYTES isn't as small as it could be.
    """
    n_tasks = -(-table_bytes(read(spark, sf_dir, "lineitem")) // DEALT_BYTES)
    if n_tasks <= spark.sparkContext.defaultParallelism:
        return table
    return table.repartition(max(n_tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def order_documents(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """One row for each order that has lines: (o_orderkey, customer struct, totals struct, items array of structs, flags array).

    which: only these orders; lines of others are dropped before any are gathered.
    """
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    if which is None:
        lines = dealt(spark, sf_dir, lines, "l_orderkey")
    else:
        orders = orders.where(which)
    orders = dealt(spark, sf_dir, orders, "o_orderkey")
    if which is not None:  # the join deals the lines as the orders are
        lines = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    lines = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("items"),
        F.sort_array(F.collect_set("l_returnflag")).alias("flags"),
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct(F.col("o_custkey").alias("id"), F.struct("o_orderpriority").alias("level")).alias("customer"), F.struct("o_totalprice", "o_orderstatus").alias("totals"), "items", "flags")


@frame("nested_struct_group", "SELECT o_orderpriority AS priority, o_orderstatus AS status, COUNT(*) AS n, COUNT(c_name) AS named FROM (SELECT DISTINCT l_orderkey FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority, o_orderstatus")
def _nested_struct_group(spark, d):
    return order_documents(spark, d).join(read(spark, d, "customer"), F.col("customer.id") == F.col("c_custkey"), "left").groupBy(F.col("customer.level.o_orderpriority").alias("priority"), F.col("totals.o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count("c_name").alias("named"))


@frame("explode_group", "SELECT l_partkey AS part, ROUND(SUM(l_quantity), 1) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def _explode_group(spark, d):
    return order_documents(spark, d).select(F.explode("items").alias("item")).groupBy(F.col("item.l_partkey").alias("part")).agg(F.round(F.sum("item.l_quantity"), 1).alias("quantity"))


@frame("explode_join", "SELECT p_brand, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 50000 GROUP BY p_brand")
def _explode_join(spark, d):
    items = order_documents(spark, d, F.col("o_totalprice") > 50000).select(F.explode("items").alias("item"))
    parts = dealt(spark, d, read(spark, d, "part"), "p_partkey")
    return items.join(parts, F.col("item.l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))


@frame("explode_nested", "SELECT o_custkey AS customer, l_orderkey AS o_orderkey, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _explode_nested(spark, d):
    per = order_documents(spark, d).groupBy("customer.id").agg(F.collect_list(F.struct("o_orderkey", "items")).alias("orders"))
    return per.select(F.col("id").alias("customer"), F.explode("orders").alias("o")).select("customer", "o.o_orderkey", F.explode("o.items").alias("i")).select("customer", "o_orderkey", F.col("i.l_linenumber").alias("line"))


@frame("explode_drops_empty", "SELECT l_orderkey AS o_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def _explode_drops_empty(spark, d):
    return order_documents(spark, d).select("o_orderkey", F.explode(F.filter("items", lambda i: i.l_returnflag == "R")).alias("i")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@frame("array_index_first", "SELECT o_orderkey, l.l_partkey AS first_part, p.p_name AS name, CAST(NULL AS BIGINT) AS beyond FROM orders JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) l ON l.l_orderkey = o_orderkey AND l.n = 1 JOIN part p ON p.p_partkey = l.l_partkey")
def _array_index_first(spark, d):
    own = order_documents(spark, d).select("o_orderkey", F.get("items", F.lit(0)).getField("l_partkey").alias("first_part"), F.get("items", F.lit(9999)).getField("l_partkey").alias("beyond"))
    return own.join(read(spark, d, "part"), F.col("first_part") == F.col("p_partkey")).select("o_orderkey", "first_part", F.col("p_name").alias("name"), "beyond")


@frame("array_last", "SELECT l_orderkey AS o_orderkey, max(l_linenumber) AS last_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def _array_last(spark, d):
    return order_documents(spark, d).select("o_orderkey", F.try_element_at("items", F.lit(-1)).getField("l_linenumber").alias("last_line"))


@frame("array_agg_struct_sorted", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def _array_agg_struct_sorted(spark, d):
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("o"))
    return per.select("o_custkey", F.array_join(F.transform("o", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@frame("array_contains_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _array_contains_filter(spark, d):
    return order_documents(spark, d).where(F.array_contains("flags", "R")).select("o_orderkey")


@frame("array_size", "SELECT l_orderkey AS o_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def _array_size(spark, d):
    return order_documents(spark, d).select("o_orderkey", F.size("items").cast("long").alias("n"))


@frame("lateral_explode", "SELECT l_orderkey AS o_orderkey, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40")
def _lateral_explode(spark, d):
    return spark.sql("SELECT o.o_orderkey, x.item.l_partkey AS part FROM {docs} o, LATERAL (SELECT explode(o.items) AS item) x WHERE x.item.l_quantity > 40", docs=order_documents(spark, d))


@frame("zip_explode", "SELECT o_orderkey, CAST(i - 1 AS BIGINT) AS at, CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 END AS a, CASE i WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'z' END AS b FROM orders, range(1, 4) t(i)")
def _zip_explode(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.posexplode(F.arrays_zip(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("b")))).select("o_orderkey", F.col("pos").cast("long").alias("at"), "col.a", "col.b")


# ---- the engine's own operators


def event_records(spark: SparkSession, sf_dir: str):
    return from_column(read(spark, sf_dir, "events"), "props", "events.props")


@frame("json_infer_events_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n FROM events GROUP BY 1")
def _json_infer(spark, d):
    return build_table(event_records(spark, d)).df.groupBy("k").agg(F.count("*").alias("n"))


@frame("json_typed_group", "SELECT event_type, CAST(SUM(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def _json_typed_group(spark, d):
    events = read(spark, d, "events")
    schema = build_table(event_records(spark, d)).df.schema
    return events.select("event_type", F.from_json("props", schema).alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("total"))


@frame("json_path_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _json_path(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@frame("json_nested_roundtrip", "SELECT l_partkey AS part, ROUND(SUM(l_quantity), 1) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def _json_roundtrip(spark, d):
    texts = order_documents(spark, d).select(F.to_json(F.struct("o_orderkey", "customer", "items")).alias("text"))
    # Inference reads the texts twice and the query once more: they are made once.
    table = build_table(from_column(texts.persist(StorageLevel.DISK_ONLY), "text")).df
    return table.select(F.explode("items").alias("item")).groupBy(F.col("item.l_partkey").alias("part")).agg(F.round(F.sum("item.l_quantity"), 1).alias("quantity"))


@frame("stats_paths_events_props", "SELECT '$[]' AS path, COUNT(*) AS total_seen, 0::BIGINT AS nulls, 0::BIGINT AS numbers, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM events UNION ALL SELECT '$[].k', COUNT(*), 0, COUNT(*), MIN(CAST(json_extract(props, '$.k') AS DOUBLE)), MAX(CAST(json_extract(props, '$.k') AS DOUBLE)) FROM events")
def _stats_paths(spark, d):
    result = stats_of(collect_facts(event_records(spark, d).raw), "array", 0)
    rows = [(f.path, f.total_seen, f.null_count, f.numbers.count, f.numbers.low, f.numbers.high) for f in result.field_stats.values() if f.path != "$"]
    return spark.createDataFrame(rows, "path string, total_seen long, nulls long, numbers long, low double, high double")


@frame("samples_enum_event_type", "SELECT DISTINCT event_type AS value FROM events")
def _samples_enum(spark, d):
    texts = read(spark, d, "events").select(F.to_json(F.struct("event_type")).alias("text"))
    facts = collect_facts(from_column(texts, "text").raw)
    from tessera.sources.json_text import loads

    return spark.createDataFrame([(loads(v),) for v in facts.at((".event_type",))["str"]["uniq"]], "value string")


@frame("inference_matrix", "SELECT * FROM (VALUES ('1,2.5', 'double'), ('1,\"a\"', 'string'), ('true,1', 'string'), ('{\"a\":1},5', 'string'), ('[1],[]', 'array<bigint>'), ('{}', 'string'), ('null', 'string'), ('1,2', 'bigint'), ('99999999999999999999', 'string'), ('{\"b\":1,\"a\":\"x\"}', 'struct<a:string,b:bigint>')) t(items, type)")
def _inference_matrix(spark, d):
    from tessera.sources.records import from_text

    cases = ["1,2.5", '1,"a"', "true,1", '{"a":1},5', "[1],[]", "{}", "null", "1,2", "99999999999999999999", '{"b":1,"a":"x"}']
    own = [(c, build_table(from_text(spark.newSession(), "[" + ",".join('{"v":' + x + "}" for x in _split(c)) + "]")).df.dtypes[0][1]) for c in cases]
    return spark.createDataFrame(own, "items string, type string")


def _split(items: str) -> list[str]:
    from tessera.sources.json_text import element_texts

    return list(element_texts(f"[{items}]"))


@frame("prompt_join_keys", "SELECT * FROM (VALUES ('customers', 'customer_id', 'orders', 'customer.customer_id')) t(left_table, left_field, right_table, right_field)")
def _prompt_join_keys(spark, d):
    """Join keys that the prompt would name, of customers and orders as JSON tables."""
    from tessera.operators.structure import root_shape
    from tessera.plans.prompt import fields_of, join_keys, record_shape

    sources = {
        "customers": read(spark, d, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))).alias("text")),
        "orders": read(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("customer_id")).alias("customer"))).alias("text")),
    }
    own = {}
    for name, texts in sources.items():
        own[name] = fields_of(record_shape(root_shape(collect_facts(from_column(texts, "text").raw), "array", 1)))
    return spark.createDataFrame(join_keys(own), "left_table string, left_field string, right_table string, right_field string")


# ---- through the engine: guarded SQL over registered tables, its ways to a result, and what it tells of itself

_FIXED_NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def engine_over(spark: SparkSession, sf_dir: str, *tables: str, **options) -> QueryEngine:
    """An engine with some of the driver's tables as frames."""
    engine = QueryEngine(spark=spark, **options)
    for t in tables:
        engine.register_df(t, read(spark, sf_dir, t))
    return engine


def engine_sql(name: str, text: str, *tables: str, oracle: str | None = None, **options) -> None:
    """A query that goes through the guard and the engine's own session; compat texts are those of the oracle."""
    frame(name, oracle or text)(lambda spark, d: engine_over(spark, d, *tables, **options).execute(text))


engine_sql("engine_lateral_alias", "SELECT o_orderkey, o_totalprice * 2 AS twice, twice + 1 AS more FROM orders", "orders")
engine_sql("engine_double_quotes", 'SELECT "c_custkey" AS "end", c."c_name" AS "first-name" FROM customer c WHERE "c_acctbal" > 0', "customer")
engine_sql("compat_qualify", "SELECT c_nationkey, c_custkey FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1", "customer", dialect="compat")
engine_sql("compat_unnest", "SELECT n_regionkey, unnest([n_nationkey, n_nationkey + 100]) AS k FROM nation", "nation", dialect="compat")
engine_sql("compat_lists", "SELECT n_nationkey, [n_nationkey, 7][2] AS second, len(n_name) AS letters, list_contains([1, 2, 3], n_regionkey) AS held, n_nationkey // 2 AS half FROM nation", "nation", dialect="compat", oracle="SELECT n_nationkey, [n_nationkey, 7][2] AS second, CAST(len(n_name) AS INTEGER) AS letters, list_contains([1, 2, 3], n_regionkey) AS held, CAST(n_nationkey // 2 AS BIGINT) AS half FROM nation")
engine_sql("compat_nulls_last", "SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY v, s_suppkey) AS n FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS v FROM supplier) x", "supplier", dialect="compat", oracle="SELECT s_suppkey, CAST(ROW_NUMBER() OVER (ORDER BY v NULLS LAST, s_suppkey) AS INTEGER) AS n FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS v FROM supplier) x")


def nation_document(spark: SparkSession, sf_dir: str) -> str:
    """The nations as one JSON document, with its rows at $.world.nations."""
    rows = [r.asDict() for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    return dumps({"world": {"nations": rows, "first": rows[0]}})


@frame("engine_path_in_text", _FIXED_NATIONS)
def _engine_path(spark, d):
    engine = QueryEngine(spark=spark).register("n", nation_document(spark, d), "$.world.nations[]")
    return engine.execute("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM n")


@frame("engine_register_many", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _engine_many(spark, d):
    regions = [r.asDict() for r in read(spark, d, "region").collect()]
    engine = QueryEngine(spark=spark).register_many({"regions": regions, "nations": (nation_document(spark, d), "$.world.nations")})
    return engine.execute("SELECT n_name, r_name FROM nations JOIN regions ON n_regionkey = r_regionkey")


@frame("engine_path_errors", "SELECT * FROM (VALUES ('$.world.nations.0.n_name', 'ok'), ('$.world.nations.99', 'out of range'), ('$.world.none', 'not found'), ('$.world.first.n_name.x', 'cannot go')) t(path, outcome)")
def _engine_path_errors(spark, d):
    document, out = loads(nation_document(spark, d)), []
    for path in ("$.world.nations.0.n_name", "$.world.nations.99", "$.world.none", "$.world.first.n_name.x"):
        try:
            walk_path(document, path)
            out.append((path, "ok"))
        except ValueError as error:
            out.append((path, next(x for x in ("out of range", "not found", "cannot go") if x in str(error))))
    return spark.createDataFrame(out, "path string, outcome string")


_WAYS_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 3"


@frame("engine_ways_to_a_result", " UNION ALL ".join(f"SELECT '{way}' AS way, n_nationkey, n_name FROM nation WHERE n_nationkey > 3" for way in ("arrow", "csv", "dicts", "iterator", "json")))
def _engine_ways(spark, d):
    with engine_over(spark, d, "nation") as engine:
        found = {"dicts": engine.query(_WAYS_SQL), "iterator": list(engine.query_iter(_WAYS_SQL, 4)), "arrow": engine.query_arrow(_WAYS_SQL).to_pylist(), "json": loads(engine.format_query(_WAYS_SQL, "json")), "csv": list(csv.DictReader(engine.format_query(_WAYS_SQL, "csv").splitlines()))}
    return spark.createDataFrame([(way, int(r["n_nationkey"]), r["n_name"]) for way, rows in found.items() for r in rows], "way string, n_nationkey int, n_name string")


@frame("engine_result_texts", "SELECT format, 5::BIGINT AS shown FROM (VALUES ('simple'), ('grid'), ('pipe'), ('markdown'), ('github'), ('csv'), ('json')) t(format)")
def _engine_texts(spark, d):
    with engine_over(spark, d, "region") as engine:
        names = [r["r_name"] for r in engine.query("SELECT r_name FROM region")]
        texts = {f: engine.format_query("SELECT r_regionkey, r_name FROM region", f) for f in FORMATS}
    return spark.createDataFrame([(f, sum(n in text for n in names)) for f, text in texts.items()], "format string, shown long")


_REFUSED = ["DROP VIEW region", "CREATE TABLE t (a INT)", "INSERT INTO region VALUES (1)", "SET a = 1", "COPY region TO 'x'", "ATTACH 'x'", "SELECT 1; SELECT 2", "SELECT * FROM nobody", "SELECT * FROM text.`/etc/hostname`", "SELECT reflect('java.lang.System', 'getenv')", "SELECT * FROM nation, (WITH nation AS (SELECT 1 AS a) SELECT * FROM nation) x", "SELECT * FROM read_csv('x.csv')"]
_ALLOWED = ["SELECT 1 AS x", "SELECT * FROM region", "EXPLAIN SELECT * FROM region", "WITH nation AS (SELECT 1 AS a) SELECT * FROM nation", "SELECT ';' AS x"]


@frame("guard_verdicts", "SELECT * FROM (VALUES " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {x})" for x, ts in (("'refused'", _REFUSED), ("'allowed'", _ALLOWED)) for t in ts) + ") t(statement, verdict)")
def _guard_verdicts(spark, d):
    out = []
    with engine_over(spark, d, "region") as engine:
        for text in _REFUSED + _ALLOWED:
            try:
                engine.guard.check(text)
                out.append((text, "allowed"))
            except ReadOnlyViolationError:
                out.append((text, "refused"))
    return spark.createDataFrame(out, "statement string, verdict string")


@frame("engine_limits", "SELECT * FROM (VALUES ('rows at the cap', 'ok'), ('rows over it', 'ResultTooLargeError'), ('bytes over the cap', 'ResultTooLargeError'), ('no such column', 'AnalysisException'), ('time', 'TimeoutError')) t(what, outcome)")
def _engine_limits(spark, d):
    cases = {"rows at the cap": "SELECT * FROM range(50)", "rows over it": "SELECT * FROM range(51)", "bytes over the cap": "SELECT space(200000 + r_regionkey) AS x FROM region", "no such column": "SELECT nothing FROM region", "time": "SELECT COUNT(*) AS n FROM range(400000000000) WHERE hash(id) % 1000003 = 3"}
    out = []
    for what, text in cases.items():
        with engine_over(spark, d, "region", max_result_rows=50, max_result_bytes=500_000, query_timeout=1.5 if what == "time" else 60) as engine:
            try:
                engine.query(text)
                out.append((what, "ok"))
            except Exception as error:
                out.append((what, type(error).__name__))
    return spark.createDataFrame(out, "what string, outcome string")


@frame("engine_tables_and_schema", "SELECT * FROM (VALUES ('region', 'r_regionkey', 'int', 5), ('region', 'r_name', 'string', 5), ('nations', 'n_name', 'string', 25), ('nations', 'n_nationkey', 'bigint', 25), ('nations', 'n_regionkey', 'bigint', 25)) t(name, field, type, n_rows)")
def _engine_tables(spark, d):
    with engine_over(spark, d, "region").register("nations", nation_document(spark, d), "$.world.nations") as engine:
        counts = re.findall(r"  (\w+):\n(?:    .*\n)*?    rows: ([\d,]+)", engine.tables_info())
        out = [(t, *line.strip().split(": "), int(n)) for t, n in counts for line in engine.schema(t).split("\n")[1:]]
    return spark.createDataFrame(out, "name string, field string, type string, n_rows int")


@frame("prompt_schema", "SELECT * FROM (VALUES (1, '[{'), (2, '  n_name: str'), (3, '  n_nationkey: int'), (4, '  n_regionkey: int'), (5, '}]')) t(line, text)")
def _prompt_schema(spark, d):
    with QueryEngine(spark=spark).register("nations", nation_document(spark, d), "$.world.nations") as engine:
        body = re.search(r"```typescript\n(.*?)\n```", engine.describe_tables(samples=0), re.S)[1]
        body = body if "\n" in body else body.replace("[{", "[{\n  ").replace(", ", "\n  ").replace("}]", "\n}]")
    return spark.createDataFrame(list(enumerate(body.split("\n"), 1)), "line int, text string")


@frame("profile_trees", "SELECT form, key, TRUE AS shown FROM (VALUES ('tree'), ('tabs'), ('bracket'), ('schema')) f(form), (VALUES ('world'), ('nations'), ('n_name'), ('n_regionkey')) k(key)")
def _profile_trees(spark, d):
    with Profiler(spark=spark) as profiler:
        profiler.analyze(nation_document(spark, d))
        out = [(form, key, key in profiler.tree(form)) for form in ("tree", "tabs", "bracket", "schema") for key in ("world", "nations", "n_name", "n_regionkey")]
    return spark.createDataFrame(out, "form string, key string, shown boolean")


@frame("profile_statistics", "SELECT * FROM (SELECT '$.world.nations[].n_name' AS path, COUNT(*) AS seen, 0::BIGINT AS nulls, SUM(length(n_name))::DOUBLE AS total, COUNT(DISTINCT n_name) AS different FROM nation UNION ALL SELECT '$.world.nations[].n_regionkey', COUNT(*), 0, SUM(n_regionkey)::DOUBLE, COUNT(DISTINCT n_regionkey) FROM nation) t")
def _profile_statistics(spark, d):
    with Profiler(spark=spark) as profiler:
        fields = profiler.analyze(nation_document(spark, d)).stats_result().field_stats
        name, region = fields["$.world.nations[].n_name"], fields["$.world.nations[].n_regionkey"]
        rows = [(f.path, f.total_seen, f.null_count, m.total, len(f.unique_values)) for f, m in ((name, name.strings), (region, region.numbers))]
    return spark.createDataFrame(rows, "path string, seen long, nulls long, total double, different long")


@frame("inference_values", "SELECT * FROM (VALUES ('9007199254740993', '9.007199254740992E15'), ('1.5', '1.5'), ('big', '123456789012345678901234567890'), ('flag', 'true'), ('mixed', '[1,2]')) t(item, value)")
def _inference_values(spark, d):
    """Integers beside fractions round, and where types conflict every digit stays."""
    own = QueryEngine(spark=spark)
    own.register("a", '[{"v": 9007199254740993}, {"v": 1.5}]').register("b", '[{"big": 123456789012345678901234567890, "flag": true, "mixed": [1, 2]}, {"big": 1, "flag": "x", "mixed": {"a": 1}}]')
    return own.execute("SELECT IF(v > 2, '9007199254740993', '1.5') AS item, CAST(v AS STRING) AS value FROM a UNION ALL SELECT * FROM (SELECT inline(array(named_struct('item', 'big', 'value', big), named_struct('item', 'flag', 'value', flag), named_struct('item', 'mixed', 'value', mixed))) FROM b WHERE flag = 'true')")


@frame("self_test", "SELECT 0::BIGINT AS n_wrong")
def _self_test(spark, d):
    return spark.createDataFrame([(len(validate(spark)),)], "n_wrong long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

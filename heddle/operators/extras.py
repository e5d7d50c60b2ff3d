"""What Spark brings along beyond the dialect: more aggregates, joins, predicates and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.sources import read_table

from .registry import frame_query, sql_query as q

q("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
q("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
q("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
q("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS large, max(o_orderkey) FILTER (WHERE o_totalprice < 1000) AS small FROM orders GROUP BY o_orderstatus")
q("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
q("agg_percentile", "SELECT c_mktsegment, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_custkey) AS middle FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, quantile_cont(c_custkey, 0.5) AS middle FROM customer GROUP BY c_mktsegment")
q("agg_stddev", "SELECT n_regionkey, round(stddev_samp(n_nationkey), 9) AS s, round(var_pop(n_nationkey), 9) AS v FROM nation GROUP BY n_regionkey")
q("agg_bool", "SELECT n_regionkey, bool_and(n_nationkey > 3) AS every_, bool_or(n_nationkey > 20) AS any_ FROM nation GROUP BY n_regionkey")

q("filter_row_in", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey % 2) IN ((1, 0), (2, 1))", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey % 2) IN (VALUES (1, 0), (2, 1))")
q("filter_distinct_from", "SELECT n_nationkey FROM nation WHERE NOT (nullif(n_regionkey, 1) <=> nullif(n_nationkey, 3))", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_nationkey, 3)")
q("filter_regex", "SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].*e$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e$')")
q("filter_any_all", "SELECT n_nationkey FROM nation WHERE n_name LIKE ANY ('A%', '%A') AND NOT n_name LIKE ALL ('A%', '%A')", "SELECT n_nationkey FROM nation WHERE (n_name LIKE 'A%' OR n_name LIKE '%A') AND NOT (n_name LIKE 'A%' AND n_name LIKE '%A')")

q("join_lateral", "SELECT n.n_nationkey, s.best FROM nation n, LATERAL (SELECT max(s_suppkey) AS best FROM supplier WHERE s_nationkey = n.n_nationkey) s")
q("join_natural", "SELECT k, a, b FROM (SELECT r_regionkey AS k, r_name AS a FROM region) x NATURAL JOIN (SELECT n_regionkey AS k, n_name AS b FROM nation) y")
q("join_using", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer) x JOIN (SELECT n_nationkey AS k FROM nation) y USING (k) GROUP BY k")

q("fn_string", "SELECT n_nationkey, substring(n_name, 2, 3) AS part, trim(concat(' ', n_name, ' ')) AS bare, replace(n_name, 'A', '-') AS other, lpad(n_name, 12, '*') AS wide, position('A' IN n_name) AS place FROM nation", "SELECT n_nationkey, substring(n_name, 2, 3) AS part, trim(concat(' ', n_name, ' ')) AS bare, replace(n_name, 'A', '-') AS other, left(repeat('*', greatest(12 - length(n_name), 0)) || n_name, 12) AS wide, CAST(position('A' IN n_name) AS INT) AS place FROM nation")
q("fn_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS days FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
q("fn_math", "SELECT n_nationkey, round(sqrt(n_nationkey), 9) AS root, CAST(power(n_nationkey, 2) AS DOUBLE) AS square, CAST(floor(n_nationkey / 3.0) AS BIGINT) AS third, CAST(sign(n_nationkey - 5) AS INT) AS side, greatest(n_nationkey, n_regionkey) AS larger FROM nation")
q("fn_array", "SELECT r_regionkey, CAST(size(names) AS BIGINT) AS n, array_join(array_sort(names), '|') AS all_ FROM (SELECT n_regionkey AS r_regionkey, collect_list(n_name) AS names FROM nation GROUP BY n_regionkey)", "SELECT n_regionkey AS r_regionkey, count(*) AS n, string_agg(n_name, '|' ORDER BY n_name) AS all_ FROM nation GROUP BY n_regionkey")
q("fn_json", """SELECT n_nationkey, get_json_object(to_json(named_struct('k', n_regionkey, 's', n_name)), '$.s') AS s FROM nation""", "SELECT n_nationkey, n_name AS s FROM nation")
q("fn_map", "SELECT n_nationkey, map('a', n_regionkey, 'b', n_nationkey)['b'] AS b FROM nation", "SELECT n_nationkey, n_nationkey AS b FROM nation")


@frame_query("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key in an order."""
    rows = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    first = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return rows.withColumn("_first", first).where("_first = 1").select("c_nationkey", "c_custkey")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of ``right``'s last row of its key that isn't later; of rows at one time, the greatest value.

    One exchange and sort by key and time of both together, with no pair of rows made.
    """
    both = left.withColumns({"_right": F.lit(0), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(key, at, F.lit(1).alias("_right"), F.col(value).alias("_value")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, F.desc("_right"), F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_right = 0").drop("_right", "_value")


@frame_query(
    """SELECT e.o_orderkey, max(p.o_orderkey) AS before FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') e
       LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O') p
       ON p.o_custkey = e.o_custkey AND p.o_orderdate = (SELECT max(x.o_orderdate) FROM orders x WHERE x.o_orderstatus = 'O' AND x.o_custkey = e.o_custkey AND x.o_orderdate <= e.o_orderdate)
       GROUP BY e.o_orderkey"""
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finished order with its customer's last open order before it."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    left = orders.where("o_orderstatus = 'F'").drop("o_orderstatus")
    right = orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("before"))
    return as_of(left, right, "o_custkey", "o_orderdate", "before").select("o_orderkey", "before")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges, ends included, that they lie in, by an equality on buckets of ``width``.

    A range is entered in each bucket that it touches, so ``width`` should be about a usual range's.
    """
    buckets = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(buckets))
    return points.withColumn("_bucket", F.floor(F.col(at) / width)).join(spread, "_bucket").where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


@frame_query("SELECT r.k, count(*) AS n FROM orders JOIN (SELECT s_suppkey AS k, s_suppkey * 1000 AS low, s_suppkey * 1000 + 2500 AS high FROM supplier) r ON o_totalprice BETWEEN r.low AND r.high GROUP BY r.k")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by ranges of their price, which overlap."""
    ranges = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 1000).alias("low"), (F.col("s_suppkey") * 1000 + 2500).alias("high"))
    orders = read_table(spark, sf_dir, "orders").select("o_totalprice")
    return in_ranges(orders, ranges, "o_totalprice", "low", "high", 2500.0).groupBy("k").agg(F.count("*").alias("n"))

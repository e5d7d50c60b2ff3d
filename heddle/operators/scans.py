"""Scans, projections, filters, scalar expressions, sorting, limits and distinct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources import partitioned, read_table

from .registry import frame_query, sql_query as q

# money is summed exactly, as whole hundredths, since Spark makes decimals of doubles by way of strings
q(
    "flagship",
    """SELECT c_mktsegment, count(*) AS n_lines,
              CAST(sum(CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DECIMAL(18,0))) AS DOUBLE) / 10000 AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
       WHERE l_shipdate >= TS'1995-01-01 00:00:00'
       GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 5""",
)
q("scan_project", "SELECT c_custkey, c_name, c_acctbal FROM customer")
q("scan_star", "SELECT * FROM nation")
q("scan_values", "SELECT col1 AS id, col2 AS name FROM VALUES (1, 'a'), (2, NULL), (3, 'c')", "SELECT id, name FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(id, name)")
q("scan_no_from", "SELECT 1 AS one, 'x' AS name, CAST(NULL AS INT) AS nothing")
q("scan_comma_list", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
q("scan_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
q("scan_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
q("scan_covering", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")

q("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F' AND o_orderkey != 5")
q("filter_or_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
q("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' OR p_type LIKE 'S%'")
q("filter_like_literal", "SELECT s FROM VALUES ('a.c'), ('abc'), ('a+c'), ('100%'), ('100x') AS t(s) WHERE s LIKE 'a.c' OR s LIKE '100!%' ESCAPE '!'", "SELECT s FROM (VALUES ('a.c'), ('abc'), ('a+c'), ('100%'), ('100x')) AS t(s) WHERE s LIKE 'a.c' OR s LIKE '100!%' ESCAPE '!'")
q("filter_ilike", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%ing'")
q("filter_in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 2, 4)")
q("filter_not_in", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (0, 2) AND n_name NOT LIKE 'A%'")
q("filter_in_null", "SELECT n_nationkey, n_regionkey IN (1, NULL) AS hit FROM nation")
q("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.06 AND l_quantity NOT BETWEEN 10 AND 40")
q("filter_is_null", "SELECT n_nationkey, nullif(n_regionkey, 1) IS NULL AS gone, nullif(n_regionkey, 1) IS NOT NULL AS there FROM nation")
q("filter_is_true", "SELECT n_nationkey FROM nation WHERE (n_regionkey > 2) IS TRUE OR (nullif(n_regionkey, 1) > 0) IS NOT TRUE")
q("bool_3vl", "SELECT a, b, a AND b AS both_, a OR b AS either, NOT a AS not_a FROM VALUES (true, NULL), (false, NULL), (CAST(NULL AS BOOLEAN), NULL), (true, false) AS t(a, b)", "SELECT a, b, a AND b AS both_, a OR b AS either, NOT a AS not_a FROM (VALUES (true, NULL::BOOLEAN), (false, NULL), (NULL, NULL), (true, false)) AS t(a, b)")
q("null_safe_eq", "SELECT a.n_nationkey FROM nation a JOIN region b ON nullif(a.n_regionkey, 1) <=> nullif(b.r_regionkey, 1)", "SELECT a.n_nationkey FROM nation a JOIN region b ON nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.r_regionkey, 1)")

q("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class FROM customer")
q("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
q("cast_types", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR(10)) AS s, CAST(CAST(n_nationkey AS VARCHAR(10)) AS BIGINT) AS b, CAST(n_regionkey AS DOUBLE) AS d, CAST(n_regionkey AS BOOLEAN) AS f FROM nation")
q("cast_bad_input", "SELECT try_cast(s AS INT) AS i, try_cast(s AS DATE) AS d FROM VALUES ('1'), ('x'), ('2024-02-29') AS t(s)", "SELECT try_cast(s AS INT) AS i, try_cast(s AS DATE) AS d FROM (VALUES ('1'), ('x'), ('2024-02-29')) AS t(s)")
q("fn_abs_coalesce_nullif_length", "SELECT c_custkey, abs(c_acctbal) AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CAST(length(c_name) AS INT) AS len FROM customer")
q("fn_length_chars", "SELECT s, CAST(char_length(s) AS INT) AS chars, CAST(octet_length(s) AS INT) AS bytes FROM VALUES ('é'), ('abc'), ('') AS t(s)", "SELECT s, CAST(length(s) AS INT) AS chars, CAST(strlen(s) AS INT) AS bytes FROM (VALUES ('é'), ('abc'), ('')) AS t(s)")
q("fn_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
q("concat_op", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR(5)) AS s, n_name || CAST(NULL AS VARCHAR(1)) AS gone FROM nation")
q("arith", "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS p, l_linenumber * 3 - 2 AS m, -l_linenumber AS neg, CAST(l_partkey % 7 AS BIGINT) AS r FROM lineitem")
q("arith_int_div", "SELECT l_orderkey, l_linenumber, l_partkey div l_linenumber AS d, try_divide(1, l_linenumber - 1) IS NULL AS by_zero FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey // l_linenumber AS d, l_linenumber = 1 AS by_zero FROM lineitem")

q("sort_nulls", "SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 12")
q("sort_nulls_first", "SELECT n_nationkey, nullif(n_regionkey, 3) AS k FROM nation ORDER BY k ASC NULLS FIRST, n_nationkey DESC LIMIT 7")
q("sort_case", "SELECT n_nationkey FROM nation ORDER BY CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END, n_name LIMIT 9")
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
q("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
q("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
q("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
q("distinct_sorted_limit", "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey DESC LIMIT 5")


@frame_query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def scan_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a filter and a projection whose rows are then dealt by hash, so that the aggregate needs no more shuffle."""
    rows = read_table(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_returnflag")
    return partitioned(rows, "hash", 8, "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"))

"""Window functions."""

from __future__ import annotations

from .registry import sql_query as q

q("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders")
q("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS r FROM part")
q("win_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INT) AS r FROM part")
q("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders")
q("win_agg_partition", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS most, min(c_acctbal) OVER (PARTITION BY c_mktsegment) AS least FROM customer")
q("win_running", "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS DOUBLE) AS running FROM lineitem")
q("win_rows_frame", "SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM lineitem")
q("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part")
q("win_peers", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part")
q("win_named", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
q("win_in_expr", "SELECT c_custkey, c_acctbal - max(c_acctbal) OVER (PARTITION BY c_nationkey) AS gap, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3 THEN 'top' ELSE 'rest' END AS class FROM customer")
q("win_over_agg", "SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS BIGINT) AS rn FROM customer GROUP BY c_nationkey, c_mktsegment")
q("win_first_last_ntile", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, ntile(3) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, CAST(ntile(3) OVER w AS INT) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
q("win_percent_nth", "SELECT p_partkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, nth_value(p_partkey, 2) OVER w AS second FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
q("top_n_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")

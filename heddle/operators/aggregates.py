"""Grouped and global aggregation."""

from __future__ import annotations

from .registry import sql_query as q

#: An exact sum of whole hundredths.
_MONEY = "CAST(sum(CAST(CAST(floor({0} * 100 + 0.5) AS BIGINT) AS DECIMAL(18,0))) AS DOUBLE) / 100"

q("agg_global", f"SELECT count(*) AS n, {_MONEY.format('o_totalprice')} AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(o_totalprice) AS mean FROM orders")
q("agg_avg", "SELECT o_orderstatus, avg(o_custkey) AS mean FROM orders GROUP BY o_orderstatus")
q("agg_empty_input", "SELECT count(*) AS n, sum(n_regionkey) AS s, CAST(avg(n_regionkey) AS DOUBLE) AS a, min(n_name) AS m FROM nation WHERE 1 = 0", "SELECT count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS s, CAST(avg(n_regionkey) AS DOUBLE) AS a, min(n_name) AS m FROM nation WHERE 1 = 0")
q("agg_empty_grouped", "SELECT n_regionkey, count(*) AS n FROM nation WHERE 1 = 0 GROUP BY n_regionkey")
q("agg_group_multi", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_MONEY.format('l_quantity')} AS qty, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("agg_null_groups", "SELECT nullif(n_regionkey, 2) AS k, count(*) AS n, count(nullif(n_regionkey, 2)) AS there FROM nation GROUP BY nullif(n_regionkey, 2)")
q("agg_count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(c_custkey) AS n FROM customer GROUP BY c_mktsegment")
q("agg_sum_avg_distinct", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
q("agg_two_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus HAVING count(DISTINCT o_custkey) > count(DISTINCT o_orderpriority)")
q("agg_having", f"SELECT o_custkey, count(*) AS n, {_MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND max(o_totalprice) > 200000")
q("agg_expr", "SELECT o_orderstatus, count(*) / nullif(count(DISTINCT o_custkey), 0) AS per_customer FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) / nullif(count(DISTINCT o_custkey), 0) AS per_customer FROM orders GROUP BY o_orderstatus")
q("agg_group_expr", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, count(*) AS n FROM customer GROUP BY CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END")
q("agg_distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) t")

"""Queries that combine operators, and the shapes that the benchmark times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .changes import engine_over
from .registry import frame_query, sql_query as q

q("composite_q91", "WITH s AS (SELECT c_nationkey, c_custkey, avg(c_custkey) OVER (PARTITION BY c_nationkey) AS mean, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place FROM customer) SELECT c_nationkey, count(*) AS above, max(CASE WHEN place = 1 THEN c_custkey END) AS richest FROM s WHERE c_custkey > mean GROUP BY c_nationkey")
q(
    "composite_q92",
    """SELECT n.n_name, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT o.o_orderkey) AS orders_, CAST(sum(CAST(l.l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
       FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
       WHERE n.n_nationkey > (SELECT avg(n_nationkey) FROM nation) GROUP BY n.n_name HAVING count(DISTINCT c.c_custkey) > 0""",
)
q(
    "composite_q94",
    """SELECT c.c_custkey, (SELECT avg(i.c_custkey) FROM customer i WHERE i.c_nationkey = c.c_nationkey) AS mean, (SELECT max(c_custkey) FROM customer) AS most,
              CASE WHEN c.c_custkey > (SELECT avg(i.c_custkey) FROM customer i WHERE i.c_nationkey = c.c_nationkey) THEN 'above' ELSE 'below' END AS place
       FROM customer c WHERE c.c_acctbal > 0""",
)
q(
    "composite_q95",
    """WITH s AS (SELECT c_nationkey AS k, avg(c_custkey) AS mean, count(*) AS n FROM customer GROUP BY c_nationkey),
            ranked AS (SELECT n.n_nationkey, n.n_name, s.mean, s.n, CAST(rank() OVER (ORDER BY s.mean DESC) AS BIGINT) AS place FROM nation n JOIN s ON n.n_nationkey = s.k)
       SELECT r.n_name, r.mean, r.n, r.place, c.c_custkey, c.c_acctbal FROM ranked r JOIN customer c ON c.c_nationkey = r.n_nationkey WHERE r.place <= 3 ORDER BY r.place, c.c_acctbal DESC""",
)
q("composite_q96", "SELECT 'high' AS kind, count(*) AS n FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT 'low', count(*) FROM customer WHERE c_acctbal <= 2000 UNION ALL SELECT 'middle', count(*) FROM customer WHERE c_acctbal > 2000 AND c_acctbal <= 8000")
q(
    "composite_q98",
    """SELECT c.c_custkey, n.n_name, count(DISTINCT o.o_orderkey) AS orders_, CAST(sum(CAST(l.l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, avg(o.o_orderkey) AS mean
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000
       LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= TS'1995-01-01 00:00:00'
       WHERE c.c_acctbal > 0 GROUP BY c.c_custkey, n.n_name HAVING count(DISTINCT o.o_orderkey) > 0 ORDER BY quantity DESC""",
)
q(
    "composite_q99",
    """SELECT o.o_orderkey, o.o_custkey, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS BIGINT) AS turn,
              CAST(rank() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC) AS BIGINT) AS place, CAST(sum(CAST(o.o_totalprice AS DECIMAL(14,2))) OVER (PARTITION BY o.o_custkey) AS DOUBLE) AS total,
              avg(o.o_orderkey) OVER (PARTITION BY o.o_custkey) AS mean, o.o_orderkey - avg(o.o_orderkey) OVER (PARTITION BY o.o_custkey) AS gap
       FROM orders o WHERE o.o_orderstatus = 'F' ORDER BY o.o_custkey, o.o_totalprice DESC""",
)

#: A recursion over a whole table, which the engine runs without Spark's limit of a million rows.
Q93 = """WITH RECURSIVE t(k, level, path) AS (
         SELECT p_partkey, 0, CAST(CAST(p_partkey AS VARCHAR(20)) AS VARCHAR(1000)) FROM part WHERE p_partkey = 0
         UNION ALL SELECT p.p_partkey, t.level + 1, CAST(t.path || ' > ' || CAST(p.p_partkey AS VARCHAR(20)) AS VARCHAR(1000)) FROM part p JOIN t ON p.p_partkey > 0 AND CAST(floor(p.p_partkey / 2) AS BIGINT) = t.k)
       SELECT k, level, path, avg(k) OVER (PARTITION BY level) AS mean_of_level FROM t"""
#: Queries that name columns two levels out, or compare with one by more than equality, which need the engine's rewrite.
Q97 = """SELECT n.n_name, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers, n.n_regionkey FROM nation n
         WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > (SELECT avg(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = n.n_nationkey))"""
Q100 = """
    WITH order_stats AS (SELECT o.o_orderkey AS k, o.o_custkey AS c, count(l.l_linenumber) AS n_lines, o.o_orderkey / nullif(count(l.l_linenumber), 0) AS per_line
                         FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_custkey),
         nation_stats AS (SELECT n.n_nationkey, n.n_name, count(DISTINCT c.c_custkey) AS customers, avg(c.c_custkey) AS mean, count(DISTINCT s.k) AS orders_, CAST(sum(s.n_lines) AS BIGINT) AS n_lines
                          FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 0 LEFT JOIN order_stats s ON s.c = c.c_custkey GROUP BY n.n_nationkey, n.n_name),
         ranked AS (SELECT *, CAST(rank() OVER (ORDER BY mean DESC) AS BIGINT) AS by_mean, CAST(rank() OVER (ORDER BY customers DESC) AS BIGINT) AS by_customers,
                           CAST(rank() OVER (ORDER BY orders_ DESC) AS BIGINT) AS by_orders, n_lines / nullif(customers, 0) AS per_customer FROM nation_stats)
    SELECT r.n_name, r.customers, r.orders_, r.mean, r.per_customer, r.by_mean, r.by_customers, r.by_orders,
           CASE WHEN r.by_mean <= 2 AND r.by_orders <= 2 THEN 'top' WHEN r.by_mean <= 3 OR r.by_orders <= 3 THEN 'good' ELSE 'average' END AS class,
           (SELECT count(*) FROM customer c WHERE c.c_nationkey = r.n_nationkey AND c.c_custkey > r.mean) AS above
    FROM ranked r WHERE r.customers > 0
    ORDER BY CASE WHEN r.by_mean <= 2 AND r.by_orders <= 2 THEN 1 WHEN r.by_mean <= 3 OR r.by_orders <= 3 THEN 2 ELSE 3 END, r.mean DESC"""


def _engine_query(name: str, sql: str, *tables: str) -> None:
    @frame_query(sql, name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir, *tables).sql(sql)


_engine_query("composite_q93", Q93, "part")
_engine_query("composite_q97", Q97, "nation", "supplier")
_engine_query("composite_q100", Q100, "nation", "customer", "orders", "lineitem")

q("bench_scan", "SELECT * FROM customer")
q("bench_scan_lines", "SELECT * FROM lineitem")
q("bench_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49")
q("bench_count", "SELECT count(*) AS n FROM lineitem")
q("bench_group", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
q("bench_sum_avg", "SELECT CAST(sum(CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS DECIMAL(18,0))) AS DOUBLE) / 100 AS total, avg(l_linenumber) AS mean FROM lineitem")
q("bench_join", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
q("bench_join3", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
q("bench_in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
q("bench_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
q("bench_top100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")

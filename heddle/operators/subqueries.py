"""Subqueries, common tables, views and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.engine import Engine
from heddle.plans.recursion import recursive_union
from heddle.sources import read_table

from .changes import engine_over
from .registry import frame_query, sql_query as q

q("sub_scalar", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 4000 FROM customer)")
q("sub_scalar_select", "SELECT n_nationkey, (SELECT max(r_regionkey) FROM region) AS most FROM nation")
q("sub_scalar_empty", "SELECT r_regionkey, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 99) AS nothing FROM region")
q("sub_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("sub_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region)")
q("sub_exists", "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 8000)")
q("sub_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
q("sub_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
q("sub_correlated_select", "SELECT n.n_nationkey, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n")
q("sub_derived", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 100")
q("sub_nested", "SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
q("sub_in_case", "SELECT n_nationkey, CASE WHEN n_regionkey = (SELECT min(r_regionkey) FROM region) THEN 'first' ELSE 'other' END AS place FROM nation")

q("cte_simple", "WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 9000) SELECT c_nationkey, count(*) AS n FROM rich GROUP BY c_nationkey")
q("cte_multi", "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT r_regionkey, r_name FROM region), c AS (SELECT r_name, count(*) AS n FROM a JOIN b ON n_regionkey = r_regionkey GROUP BY r_name) SELECT * FROM c")
q("cte_reuse", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT x.k, x.n FROM t x WHERE x.n = (SELECT max(n) FROM t)")
q("cte_columns", "WITH t(a, b) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT a, b FROM t")
q("cte_nested", "WITH t AS (WITH u AS (SELECT n_regionkey AS k FROM nation) SELECT k, count(*) AS n FROM u GROUP BY k) SELECT k FROM t WHERE n > 4")
q("cte_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
TREE = "WITH RECURSIVE t(k, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION ALL SELECT p.p_partkey, t.level + 1 FROM part p JOIN t ON p.p_partkey > 0 AND CAST(floor(p.p_partkey / 2) AS BIGINT) = t.k) SELECT level, count(*) AS n FROM t GROUP BY level"


@frame_query(TREE)
def cte_recursive_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table by its tree, which the engine runs without Spark's limit of a million rows."""
    return engine_over(spark, sf_dir, "part").sql(TREE)


@frame_query("WITH RECURSIVE r(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (k * 7 + 3) % 50 FROM r) SELECT k FROM r")
def cte_recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle, which UNION ends."""
    return Engine(spark).sql("WITH RECURSIVE r(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (k * 7 + 3) % 50 FROM r) SELECT k FROM r")


@frame_query(
    """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 2 + n_regionkey) % 25 AS b FROM nation),
            r(k) AS (SELECT 3 UNION SELECT b FROM e JOIN r ON a = k) SELECT k FROM r"""
)
def recursive_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that can be reached in a graph with cycles, by the fixed point over DataFrames."""
    edges = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + F.col("n_regionkey")) % 25).cast("int").alias("b"))
    return recursive_union(spark.range(1).select(F.lit(3).alias("k")), lambda d: d.join(edges, F.col("a") == F.col("k")).select(F.col("b").alias("k")))


@frame_query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name HAVING count(*) > 1")
def view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "customer", "nation")
    e.sql("CREATE VIEW rich (name, n) AS SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name")
    return e.sql("SELECT name AS n_name, n FROM rich WHERE n > 1")


@frame_query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey >= 100 GROUP BY o_orderstatus")
def matview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that is made, goes stale by a change, and is refreshed."""
    e = engine_over(spark, sf_dir, "orders")
    e.sql("CREATE MATERIALIZED VIEW by_status AS SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    e.sql("DELETE FROM orders WHERE o_orderkey < 100; REFRESH MATERIALIZED VIEW by_status")
    return e.sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")


@frame_query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'NEW'), (101, 'none')) v")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "nation")
    e.sql("CREATE TABLE places (id INTEGER PRIMARY KEY, name VARCHAR(30) DEFAULT 'none'); INSERT INTO places SELECT n_nationkey, n_name FROM nation; INSERT INTO places VALUES (100, 'NEW'), (101, DEFAULT)")
    return e.sql("SELECT id AS n_nationkey, name AS n_name FROM places")


@frame_query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "customer")
    e.sql("UPDATE customer SET c_acctbal = 0, c_mktsegment = 'DEBT' WHERE c_acctbal < 0")
    return e.sql("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")


@frame_query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 150000 AND o_orderstatus = 'F')")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "orders")
    e.sql("DELETE FROM orders WHERE o_totalprice < 150000 AND o_orderstatus = 'F'")
    return e.sql("SELECT o_orderkey FROM orders")


@frame_query("SELECT count(*) AS n, max(n_nationkey) AS most FROM nation")
def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "nation")
    e.sql("BEGIN; INSERT INTO nation VALUES (99, 'X', 0); UPDATE nation SET n_name = 'Y'; DELETE FROM nation WHERE n_nationkey < 5; ROLLBACK")
    return e.sql("SELECT count(*) AS n, max(n_nationkey) AS most FROM nation")


@frame_query("SELECT count(*) AS n, max(n_nationkey) AS most FROM (SELECT n_nationkey FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 99)")
def tx_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "nation")
    e.sql("BEGIN; INSERT INTO nation VALUES (99, 'X', 0); DELETE FROM nation WHERE n_nationkey < 5; COMMIT")
    return e.sql("SELECT count(*) AS n, max(n_nationkey) AS most FROM nation")


@frame_query("SELECT n_nationkey, n_nationkey * 2 + 1 AS y FROM nation")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "nation")
    e.sql("CREATE FUNCTION twice_and_one(x INT) RETURNS INT RETURN x * 2 + 1")
    return e.sql("SELECT n_nationkey, twice_and_one(n_nationkey) AS y FROM nation")


@frame_query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_nationkey")
def sql_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "customer")
    e.sql("CREATE PROCEDURE trim_poor(IN least DOUBLE PRECISION) LANGUAGE SQL AS BEGIN DELETE FROM customer WHERE c_acctbal <= least; SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey; END")
    return e.sql("CALL trim_poor(1000)")


@frame_query("SELECT 120 AS f")
def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.sql("CREATE PROCEDURE factorial(IN n INTEGER, OUT f INTEGER) LANGUAGE SQL AS BEGIN SET f = 1; WHILE n > 1 DO SET f = f * n; SET n = n - 1; END WHILE; END")
    return e.sql("CALL factorial(5)")


@frame_query("SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS INT) AS grade, 'new' AS state FROM supplier")
def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "supplier")
    e.sql("ALTER TABLE supplier DROP COLUMN s_acctbal; ALTER TABLE supplier ADD COLUMN rank INTEGER; ALTER TABLE supplier RENAME COLUMN rank TO grade; ALTER TABLE supplier ADD COLUMN state VARCHAR(5) DEFAULT 'new'; ALTER TABLE supplier RENAME TO sellers")
    return e.sql("SELECT * FROM sellers")


@frame_query("SELECT * FROM (VALUES ('t', 'id', 0, 'INTEGER', FALSE), ('t', 'name', 1, 'TEXT', TRUE)) v(table_name, column_name, position, data_type, is_nullable)")
def system_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    return e.sql("SELECT table_name, column_name, position, data_type, is_nullable FROM pg_column WHERE table_name = 't'")

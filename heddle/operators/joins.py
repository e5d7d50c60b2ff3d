"""Joins of all kinds, and the same join by each physical strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from heddle.sources import read_table

from .registry import frame_query, sql_query as q

q("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
q("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
q("join_right", "SELECT c.c_custkey, n.n_name FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey")
q("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey")
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("join_theta", "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier a JOIN nation b ON a.s_nationkey > b.n_nationkey AND a.s_acctbal < b.n_nationkey * 300")
q("join_multi", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000")
q("join_null_keys", "SELECT a.n_nationkey AS a, b.r_name AS b FROM nation a LEFT JOIN region b ON nullif(a.n_regionkey, 2) = b.r_regionkey")
q("join_left_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 250000)")
q("join_left_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")


def right_semi(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows of ``right`` that have a match in ``left``."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows of ``right`` that have none in ``left``."""
    return right.join(left, on, "left_anti")


@frame_query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def join_right_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rich = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return right_semi(rich, nation, nation.n_nationkey == rich.s_nationkey)


@frame_query("SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def join_right_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rich = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return right_anti(rich, nation, nation.n_nationkey == rich.s_nationkey)


#: Hints by strategy; without one Spark chooses by size and at run time.
STRATEGIES = {"broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}

for _name, _hint in STRATEGIES.items():
    q(
        f"join_by_{_name}",
        f"SELECT /*+ {_hint}(n) */ s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
        "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
    )

import pytest
from pyspark.sql import functions as F

from heddle.engine import Engine
from heddle.errors import EngineError, StatementError
from heddle.functions import pg_div, register_aggregate, register_scalar, register_table, truth
from heddle.operators import QUERIES
from heddle.operators.joins import STRATEGIES
from heddle.plans import statements as S
from heddle.plans.explain import operators, pushed_filters, read_schemas
from heddle.plans.recursion import recursive_union
from heddle.plans.statistics import column_statistics, histogram, most_common
from heddle.sources import read_table
from heddle.streaming import follow


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = QUERIES["scan_covering"](spark, sf)
    assert "GreaterThan(l_quantity,45.0)" in pushed_filters(df)[0]
    assert read_schemas(df) == ["struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>"]


def test_top_k_doesnt_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in operators(QUERIES["top_k"](spark, sf))


@pytest.mark.parametrize(("name", "node"), [("broadcast", "BroadcastHashJoin"), ("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("nested_loop", "CartesianProduct")])
def test_strategies(spark, sf, name, node):
    assert name in STRATEGIES
    assert node in operators(QUERIES[f"join_by_{name}"](spark, sf))


def test_update_is_one_projection(spark, sf):
    e = Engine(spark)
    e.register("customer", read_table(spark, sf, "customer"))
    e.sql("UPDATE customer SET c_acctbal = 0 WHERE c_acctbal < 0")
    assert not {"BroadcastHashJoin", "SortMergeJoin", "Exchange"} & set(operators(e.sql("SELECT * FROM customer")))


def test_split_keeps_blocks_together():
    sql = "SELECT 'a;b'; -- c;\nCREATE PROCEDURE p() AS BEGIN IF x THEN SELECT 1; END IF; SELECT CASE WHEN a THEN 1 END; END; BEGIN; SELECT 2"
    assert [s[0].up for s in S.split(sql)] == ["SELECT", "CREATE", "BEGIN", "SELECT"]
    with pytest.raises(StatementError):
        S.tokens("SELECT \x01")


def test_recursion_raises_beyond_its_rounds(spark):
    with pytest.raises(EngineError):
        recursive_union(spark.sql("SELECT 1 AS n"), lambda d: d.select((F.col("n") + 1).alias("n")), most_rounds=3)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "b")], "n int, s string")
    got = {r.column_name: r for r in column_statistics(df).collect()}
    assert (got["n"].n_rows, got["n"].null_share, got["n"].n_distinct, got["n"].least, got["s"].greatest) == (4, 0.25, 2, "1", "b")
    assert histogram(df, "n", 2) == [1, 2, 2]
    assert [(r.value, r.share) for r in most_common(df, "s", 1).collect()] == [("b", 0.5)]


def test_functions(spark):
    df = spark.createDataFrame([(7, 2, True), (-7, 2, None), (7, 0, False)], "a int, b int, c boolean")
    assert [tuple(r) for r in df.select(pg_div("a", "b"), truth("c")).collect()] == [(3, True), (-3, False), (None, False)]
    register_scalar(spark, "plus_one", lambda s: s + 1, "long")
    register_aggregate(spark, "spread", lambda s: float(s.max() - s.min()), "double")

    class Repeat:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    register_table(spark, "repeat_rows", Repeat, "i: int")
    df.createOrReplaceTempView("ab")
    assert [r[0] for r in spark.sql("SELECT plus_one(b) FROM ab").collect()] == [3, 3, 1]
    assert spark.sql("SELECT spread(a) FROM ab").first()[0] == 14.0
    assert [r.i for r in spark.sql("SELECT * FROM repeat_rows(3)").collect()] == [0, 1, 2]


def test_a_stream_fills_a_table(spark, sf, tmp_path):
    e = Engine(spark)
    e.sql("CREATE TABLE ev (event_id BIGINT PRIMARY KEY, event_type TEXT)")
    e.sql("CREATE MATERIALIZED VIEW kinds AS SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = follow(e, stream, "ev", str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    assert sorted(map(tuple, e.sql("SELECT * FROM kinds").collect())) == sorted((r.event_type, r["count"]) for r in events.groupBy("event_type").count().collect())

import pytest
from helpers import same_rows

from heddle.operators import ORACLE, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", ["composite_q93", "cte_recursive_tree"])
def test_recursion_of_more_rows_than_sparks_limit(spark, sf, duck, name):
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "20")
    try:
        same_rows(QUERIES[name](spark, sf), duck.sql(ORACLE[name]))
    finally:
        spark.conf.unset(key)

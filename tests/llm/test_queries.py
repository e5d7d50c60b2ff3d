import pytest
from helpers import same_rows

from heddle.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(ORACLE[name]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for table in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_in_every_column_and_repeated_rows(spark, sf, tmp_path, name):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, "some words here", "en", "a", 5), (1, "some words here", "en", "a", 5), (2, None, None, None, None), (None, "some words here", None, "a", 1), (None, None, None, None, None), (3, "", "en", "b", 0), (4, long, "de", "b", 9), (5, "\n \t", "en", None, 3)]
    extra = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, found string, score int, shard int")
    extra.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words here"), (None, None), (2, ""), (1, "some words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (4, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None, None), (1, "", ""), (2, "http://a/b", long)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op1_quality":
        assert sum(r.host in ("a", None) for r in got) >= 3
        got = [r for r in got if r.page_id is None and not (r.doc_id is None and r.host is None and r.path is None)] + [r for r in got if r.page_id is r.doc_id is r.host is r.path is None][:1]
    if name == "op10_packing":
        assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)

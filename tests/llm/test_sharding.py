import collections
import random
import time
import zlib

import pytest

from heddle.llm import sharding as H
from heddle.llm.queries import QUERIES


def check(rows, docs, n=8, slack=0.02):
    got = [r.asDict() for r in rows.collect()]
    assert len(got) == len(docs)
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n))
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(n):
        assert abs(sum(r["size"] for r in by[s]) - total / n) <= largest + slack * total / n
    return got


def test_documents(spark, documents, texts):
    check(H.placed(documents), texts)


def test_one_text_holds_a_third(spark):
    random.seed(6)
    docs = [(i, "the same words in all of these") for i in range(1000)] + [(1000 + i, "x" * random.randrange(1, 90)) for i in range(2000)] + [(7, None), (None, ""), (7, None)]
    got = check(H.placed(spark.createDataFrame(docs, "doc_id long, text string")), docs)
    assert len({r["shard"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["size"] == 31}) > 1


def test_a_record_repeated_a_thousand_times(spark):
    docs = [(1, "same")] * 1000 + [(2, "other")] * 10
    check(H.placed(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_small_groups_stay_together(spark):
    docs = [(i, f"text {i // 3} " + "x" * 50) for i in range(6000)]
    got = check(H.placed(spark.createDataFrame(docs, "doc_id long, text string")), docs)
    shards = collections.defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


@pytest.mark.parametrize("n", [1, 3])
def test_other_numbers_of_shards(spark, n):
    docs = [(i, "x" * (i % 17)) for i in range(500)]
    check(H.placed(spark.createDataFrame(docs, "doc_id long, text string"), n), docs, n)


def test_files(spark, tmp_path):
    docs = [(i, f"t{i}" * (i % 9), i) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard int")
    H.write_sharded(df, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("doc_id", "text", "shard").collect())) == sorted(docs)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == [f"_shard={i}" for i in range(4)]


def test_very_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(H, "LEAST_RANGES", 8192)
    docs = [(i, f"text {i // 2}") for i in range(20_000)] + [(i, "the same words in all of these") for i in range(20_000, 30_000)]
    began = time.time()
    rows = H.placed(spark.createDataFrame(docs, "doc_id long, text string"))
    got = check(rows, docs, slack=0.001)
    assert time.time() - began < 60
    shards = collections.defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    del shards[zlib.crc32(b"the same words in all of these")]
    assert all(len(s) == 1 for s in shards.values())


def test_a_kept_group_in_several_ranges_stays_whole(spark, monkeypatch):
    """Groups that are over twice a range, and so are subdivided, but under the share of a shard from which they are cut."""
    monkeypatch.setattr(H, "LEAST_RANGES", 4096)
    monkeypatch.setattr(H, "TOLERANCE", 0.05)
    docs = [(i, f"group {i // 200}") for i in range(60_000)]
    got = check(H.placed(spark.createDataFrame(docs, "doc_id long, text string")), docs, slack=0.05)
    shards = collections.defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert len(shards) == 300 and all(len(s) == 1 for s in shards.values())


def test_the_query_follows_its_law(spark, sf, texts):
    rows = QUERIES["op6_sharding"](spark, sf)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = check(rows, texts)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)

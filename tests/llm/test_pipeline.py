import re
import zlib

import numpy as np
import public_tokenizers
from llm_helpers import words
from test_credentials import spans
from test_decontaminate import brute as contaminated
from test_near_dups import brute as grouped
from tokenizers import Tokenizer

import corpus_pipeline as C
from heddle.llm import toxicity


def test_stages_keep_the_columns(spark, sf):
    assert [n for n, _ in C.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.columns


def test_same_as_brute_force(spark, sf, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    planted = [(10**6 + i, f"document {i} tells of a{i} b{i} c{i} and password = {'copied-around' if i % 2 else 'live-one-' + str(i)} and more", "en", f"src{i}", 60) for i in range(8)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.union(spark.createDataFrame(planted, docs.schema)).coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.c5.score for r in toxicity.scored(docs, model).toDF("doc_id", "text", "lang", "source", "n_chars", "c5").collect()}
    left = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect() if scores[r.doc_id] < toxicity.THRESHOLD]
    first = {c for _, c, _ in grouped([x[:2] for x in left])}
    left = [x for x in left if x[0] in first or not words(x[1])]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [x for x, (n, hit, _) in zip(left, contaminated([x[1] for x in left], items), strict=True) if not (hit and 20 * hit >= n)]
    owners, repos = {}, {}
    for _, text, source, lang in left:
        for s in spans(text):
            owners.setdefault(s[3], set()).add(source)
            repos.setdefault(s[3], set()).add((source, lang))
    copied = {k for k in owners if len(owners[k]) >= 3 or len(repos[k]) >= 6}
    masked = {}
    for d, text, _, _ in left:
        out, at = "", 0
        for a, _, b, secret in spans(text):
            if secret not in copied:
                out += text[at:a] + "[SECRET]" if a >= at else ""
                at = max(at, b)
        masked[d] = out + text[at:]
    assert ["[SECRET]" in masked[10**6 + i] for i in range(8)] == [True, False] * 4
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in masked.items()}
    got = C.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert not re.search("localCheckpoint", open(C.__file__).read())


def edge_tables(spark, sf, folder, rows):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string, score int, shard int, c0 int, class_id int, `a.b` int"
    spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_nulls_long_texts_repeated_rows_and_clashing_columns(spark, sf, tmp_path):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    own = "a document of its own with words enough to be told from all of the others here"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [
        (1, own, "en", "a", 5), (1, own, "en", "a", 5), (9, own, "en", "b", 5), (None, own, None, None, None),
        (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "de", "b", 9), (5, long + " more", "de", None, 9), (6, "\n \t", "en", None, 3),
        (None, "another text, of a null id, with password=abcdefgh1234 in it", "en", None, 1), (7, passage, "en", "a", 1),
    ]
    sf_dir = edge_tables(spark, sf, tmp_path, rows)
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        kept.append(sorted((r.doc_id or 0, r.text or "") for r in out.collect()))
        docs = out
    assert [len(x) for x in kept] == [12, 8, 7, 7]
    assert sorted({r[0] for r in kept[-1]}) == [0, 1, 2, 3, 4, 6] and (0, "another text, of a null id, with [SECRET] in it") in kept[-1]
    got = C.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 6}
    assert sorted(r.doc_tokens for r in got if r.doc_id in (2, 3, 6))[:3] == [1, 1, 1]


def test_empty_tables(spark, sf, tmp_path):
    assert C.run(spark, edge_tables(spark, sf, tmp_path, [])).collect() == []
    # only the documents hold rows
    (tmp_path / "some").mkdir()
    (tmp_path / "none").mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = C.run(spark, edge_tables(spark, str(tmp_path / "none"), tmp_path / "some", [(1, "some words", "en", "a", 1)])).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.length for r in got) == got[0].doc_tokens

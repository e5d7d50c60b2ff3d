import random

import pyarrow as pa
import pytest
from llm_helpers import words

from heddle.llm import decontaminate as D
from heddle.llm import textcore as X


def brute(texts, items):
    windows = {}
    for i, text in items:
        if w := words(text):
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for text in texts:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [True] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


def searched(texts, items):
    block, out = D.Items([i for i, _ in items], [t for _, t in items], 0, 13), []
    for a, b, part in X.slices(pa.array(texts, pa.string())):
        w = X.words(part, X.LOWER_WORDS, lower=True)
        hit, found, best = D.search(w, block)
        for i in range(b - a):
            own = hit[w.first[i] : w.first[i + 1]]
            out.append((len(own), int(own.sum()), sorted(found[i]), best[i].tolist()))
    return out


@pytest.mark.parametrize("shard", [60, 300, 1_000_000])
def test_same_as_brute_force(monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    random.seed(shard)
    vocabulary = "a b c é dd".split()
    texts = [" ".join(random.choices(vocabulary, k=random.choice([0, 1, 5, 30, 400]))) for _ in range(60)] + [None, ""]
    items = [(k, " ".join(random.choices(vocabulary, k=random.choice([1, 3, 13, 14, 20])))) for k in range(15)] + [(90, texts[3][:60]), (93, "--")]
    got = searched(texts, items)
    assert [x[:3] for x in got] == brute(texts, items)


def test_longest_match_and_its_place():
    passage = [f"w{i}" for i in range(30)]
    texts = ["x y " + " ".join(passage[3:25]) + " z " + " ".join(passage[:14]), "none of it"]
    got = searched(texts, [(7, " ".join(passage)), (8, " ".join(passage[5:19]))])
    assert got[0][3] == [22, 0, 2]
    assert got[0][2] == [7, 8]
    assert got[1][1:3] == (0, [])


def test_blocks_of_items_add_up(spark):
    passages = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(5)]
    docs = spark.createDataFrame([(1, passages[0] + " and " + passages[3], "keep"), (2, " ".join(f"q{i}" for i in range(30)), "keep"), (3, None, None)], "doc_id long, text string, c0 string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    one = D.report(docs, items).collect()
    many = D.report(docs, items, block_bytes=150).collect()
    assert sorted(one) == sorted(many)
    assert {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in one} == {1: (40, ["0", "3"], True), 2: (0, [], False), 3: (0, [], False)}
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_a_twentieth_is_needed(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(n, passage + " x" * (n - 13)) for n in (260, 261)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in D.report(docs, items).collect()} == {260: True, 261: False}


def test_ids_of_any_type_and_null(spark):
    passage = [f"p{i}" for i in range(40)]
    docs = spark.createDataFrame([("a", " ".join(passage[10:35])), (None, "x " + " ".join(passage[:15]))], "doc_id string, text string")
    items = spark.createDataFrame([("é/1", " ".join(passage[:30])), ("b", " ".join(passage[12:])), (None, " ".join(passage[:20])), ("c", None), ("b", " ".join(passage[12:]))], "item_id string, text string")
    for size in (16 << 20, 10):
        got = {r.doc_id: r for r in D.report(docs, items, block_bytes=size).collect()}
        assert got["a"]["items"] == ["b", "é/1"] and got[None]["items"] == [None, "é/1"]
        assert (got["a"].longest_words, got["a"].longest_item, got["a"].longest_start) == (23, "b", 2)
        assert (got[None].longest_words, got[None].longest_item, got[None].longest_start) == (15, None, 1)

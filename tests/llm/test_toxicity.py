import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from llm_helpers import WORDS, lower

from heddle.llm import textcore as X
from heddle.llm import toxicity as T
from heddle.llm.queries import QUERIES


def parsed(texts):
    ((_, _, part),) = X.slices(pa.array(texts, pa.string()), 1 << 30)
    return X.words(part, X.LOWER_WORDS, lower=True)


def corpus(n=1200):
    random.seed(4)
    vocabulary, bad = [f"w{i}" for i in range(400)], ["grok", "blargh", "zwick"]
    rows = []
    for i in range(n):
        sentences = [random.choices(vocabulary, k=8) for _ in range(random.choice([1, 4, 12]))]
        toxic = random.random() < 0.2
        if toxic:
            for _ in range(random.choice([1, 2])):
                random.choice(sentences).insert(3, random.choice(bad) + random.choice(["", "ed", "ing"]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return rows


def test_sentences():
    sentence, first = T.sentences(parsed(["a b. c! d\ne", None, "...", "f? g"]))
    assert sentence.tolist() == [0, 0, 1, 2, 3, 4, 5]
    assert first.tolist() == [0, 4, 4, 4, 6]


def test_noisy_or():
    w = parsed(["bad. good.", "good.", "", "bad. bad."])
    vocabulary = np.sort(X.hashes(parsed(["bad"])))
    score, each, _, _ = T.doc_scores(T.Model(vocabulary, np.array([4.0]), -3.0), w)
    p, q = 1 / (1 + np.exp(-1)), 1 / (1 + np.exp(3))
    assert np.allclose(score, [1 - (1 - p) * (1 - q), q, 0, 1 - (1 - p) ** 2])
    assert np.allclose(each, [p, q, q, p, p])


def test_learned_from_documents_finds_sentences(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = T.trained(docs, labels)
    got = {r.doc_id: r.got for r in T.scored(docs, model).toDF("doc_id", "text", "score", "got").collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert len(held) > 300
    assert np.mean([(got[i].score >= T.THRESHOLD) == y for i, _, y in held]) > 0.97
    named = [t[x.start : x.end] for i, t, _ in held for x in got[i].offending]
    assert named and np.mean([any(b in s for b in ("grok", "blargh", "zwick")) for s in named]) > 0.95
    assert all("." not in s for s in named)
    kept = T.harmless(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.score < T.THRESHOLD}


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    models = [T.trained(docs, spark.createDataFrame([(i, 1 - y if held(i) and flip else y) for i, _, y in rows], "doc_id long, toxic int")) for flip in (False, True)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_one_kind_of_labels(spark):
    docs = spark.createDataFrame([(0, "a b. c"), (2, None)], "doc_id long, text string")
    for y, want in ((0, [0.0, 0.0]), (None, [0.0, 0.0])):
        model = T.trained(docs, spark.createDataFrame([(0, y)], "doc_id long, toxic int"))
        assert [round(r.got.score, 6) for r in T.scored(docs, model).toDF("i", "t", "got").orderBy("i").collect()] == want


def test_length_alone_is_not_toxic(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.trained(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    score = T.doc_scores(model, parsed([t for _, t, _ in rows]))[0]
    clean = "\n".join(t for (_, t, y), s in zip(rows, score, strict=True) if not y and s < T.THRESHOLD)
    clean = "\n".join([clean] * (4_000_000 // len(clean) + 1))
    long = spark.createDataFrame([(0, clean), (1, clean + "\nw1 w2 w3 grok w4 w5 w6 w7 w8."), (2, None), (3, "...")], "doc_id long, text string")
    got = {r.i: r.got for r in T.scored(long, model).toDF("i", "t", "got").collect()}
    assert got[0].score < T.THRESHOLD <= got[1].score and got[2].score == got[3].score == 0
    assert [clean[x.start : x.end] for x in got[0].offending] == [] and got[1].offending[-1].start > len(clean)


def test_long_labelled_documents_are_learned(spark):
    filler = " ".join(f"w{k}" for k in range(12_000)) + ". "
    rows = [(i, (filler if y else filler * 2) + ("grok. " if y else ""), y) for i, _, y in corpus(100)]
    assert min(len(t) for _, t, _ in rows) > 32_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.trained(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    score = T.doc_scores(model, parsed(["w1 w2 w3", "w1 w2 w3. grok"]))[0]
    assert score[0] < T.THRESHOLD <= score[1]


def brute(model, text):
    """A text's score and offending sentences, word by word and sentence by sentence."""
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    found = []
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        words_in = list(WORDS.finditer(lower(m[0])))
        if not words_in:
            continue
        z = model.bias
        for word in (x[0].encode() for x in words_in):
            for kind in T.KINDS:
                if not kind or len(word) > kind:
                    part = word[:kind] if kind else word
                    one = X.Words(np.frombuffer(part + bytes(8), np.uint8), np.array([0]), np.array([len(part)]), np.array([0, 1]))
                    z += weight.get(int(X.hashes(one, seed=kind)[0]), 0.0)
        found.append((m.start() + words_in[0].start(), m.start() + words_in[-1].end(), 1 / (1 + math.exp(-z)), z))
    if not found:
        return 0.0, []
    clean = 1.0
    for *_, p, z in found:
        clean *= 1 / (1 + math.exp(z)) if p >= model.least else 1.0
    score = max(1 - clean, max(p for *_, p, _ in found))
    return score, [(a, b) for a, b, p, _ in found if p >= 0.5] if score >= T.THRESHOLD else []


def test_query_same_as_brute_force(spark, sf, texts):
    model = T.trained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.vocabulary) > 10
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    assert len(got) == len(texts) and any(r.offending for r in got.values())
    for i, text in texts:
        score, places = brute(model, text)
        assert abs(got[i].score - score) < 1e-9 and got[i].predicted == (score >= T.THRESHOLD)
        assert got[i].offending == ",".join(f"{a}:{b}" for a, b in places)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_a_score_doesnt_depend_on_its_neighbours():
    random.seed(1)
    vocabulary = np.sort(X.hashes(parsed([" ".join(f"w{i}" for i in range(200))])))
    model = T.Model(vocabulary, np.array([random.gauss(0, 1) for _ in vocabulary]), -1.0)
    some = [". ".join(f"w{random.randrange(200)} w{random.randrange(200)}" for _ in range(random.randrange(1, 400))) for _ in range(30)]
    alone = [T.doc_scores(model, parsed([t]))[0][0] for t in some]
    assert T.doc_scores(model, parsed(some))[0].tolist() == alone
    assert T.doc_scores(model, parsed(["x. " * 100_000, *some]))[0][1:].tolist() == alone

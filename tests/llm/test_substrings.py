import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import SPACED, by_text

from heddle.llm import substrings as S
from heddle.llm import textcore as X


def brute(rows):
    least, split = {}, [SPACED.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - 12) if d is not None else ():
            x = tuple(w[k : k + 13])
            least[x] = min(least.get(x, d), d)
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and least[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def random_rows():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "xyzxyzxyzxyz"]
    passages = [random.choices(vocabulary, k=random.choice([13, 30, 80])) for _ in range(10)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(random.choice([0, 1, 2, 4])):
            p = random.choice(passages)
            at = random.randrange(len(p))
            w += p[at : at + random.choice([5, 13, 20, 90])] + random.choices(vocabulary, k=random.choice([0, 1, 10]))
        rows.append((i * 7 % 211, random.choice([" ", "\n", " \t "]).join(w)))
    return [*rows, (None, rows[5][1]), (None, "a " * 50), (900, "a " * 50), (901, "a " * 30), (3, None), (4, ""), (901, "a " * 30), (902, "b " * 12), (903, "b " * 12), (-5, "a " * 15)]


#: All of one kind: every anchor is hot and the filters are full; many small blocks, automata and shards.
EVERY_WAY = [S.Limits(), S.Limits(hot=0, most_bits=11), S.Limits(hot=3, block_bytes=500, automaton_words=30, summed=10, merged_bytes=500, shard_bytes=2_000), S.Limits(most_bits=11, block_bytes=1)]


@pytest.mark.parametrize("limits", EVERY_WAY)
def test_same_as_brute_force(spark, limits):
    rows = random_rows()
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, row int")
    got = S.repeats(df, keep_text=True, limits=limits).collect()
    assert by_text((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == by_text(brute(rows))
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)


def test_without_texts(spark):
    rows = random_rows()
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_text((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == by_text(x[:4] for x in brute(rows))


def parsed(texts):
    ((_, _, part),) = X.slices(pa.array(texts, pa.string()), 1 << 30)
    return part


def test_places_come_from_the_automata():
    words = [f"w{i}" for i in range(70_000)]
    phrases = [" ".join(words[a : a + n]) for a, n in ((0, 13), (5, 20), (69_000, 1_000), (300, 13))]
    texts = ["x " + " ".join(words[:40]) + " y", phrases[0], " ".join(words[:12]), "", " ".join(words[69_000:])]
    w = X.words(parsed(texts), X.SPACED_WORDS)
    want = sorted((int(w.first[d]) + a, n, least) for d, a, n, least in ((0, 1, 13, 7), (0, 6, 20, 8), (1, 0, 13, 7), (4, 0, 1_000, 9)))
    for most in (10, 400_000):
        compiled = S.Phrases(parsed([*phrases, " ".join(words)]), np.array([7, 8, 9, 10, 11]), most)
        assert compiled.n_digits == 3 and len(compiled.automata) == (5 if most == 10 else 1)
        start, size, least = compiled.located(w)
        assert sorted(zip(start.tolist(), size.tolist(), least.tolist(), strict=True)) == want


def test_without_automata_nothing_is_removed(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(30))) for i in range(5)]
    assert sum(r.n_removed for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 120
    ((_, _, texts),) = X.slices(pa.array([rows[0][1]], pa.string()))
    (batch,) = S._removed(None, pa.array([5]), pa.array([rows[0][1]]), False)
    assert batch.column(2).to_pylist() == [0] and len(texts) == 1


def test_one_id_and_third_of_rows_alike(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text)] * 30 + [(i, text + f" end{i}") for i in range(2, 32)] + [(None, text)] * 30
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string"), limits=S.Limits(hot=1)).collect()
    assert by_text((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == by_text(x[:4] for x in brute(rows))

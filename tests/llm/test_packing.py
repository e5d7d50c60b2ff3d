import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heddle.llm import packing as P
from heddle.llm import textcore as X

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_cached_words_make_the_same_ids(tokenizer, texts, monkeypatch):
    values = [t for _, t in texts] + [None, "", "don't '' <|endoftext|>x é é İI b 1,234.5 x''s", "a" * 500 + " b", "　x y", "日本語 mixed123text"]
    want = [x.ids for x in tokenizer.encode_batch([v or "" for v in values], add_special_tokens=False)]
    for most in (1_000_000, 500):
        monkeypatch.setattr(P, "CACHE_WORDS", most)
        cache, got = P.WordIds(tokenizer), []
        for a, b, part in X.slices(pa.array(values), most_bytes=20_000):
            ids, at = cache.tokens(part)
            got += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
        assert got == want


def test_closest_is_the_best_multiset():
    random.seed(8)
    for _ in range(60):
        counts = {random.randrange(1, 30): random.randrange(1, 4) for _ in range(random.randrange(1, 6))}
        room = random.randrange(0, 80)
        chosen = P.closest(counts, room)
        assert all(n <= counts[x] for x, n in chosen.items())
        every = itertools.product(*[[x * n for n in range(m + 1)] for x, m in counts.items()])
        assert sum(x * n for x, n in chosen.items()) == max(s for s in map(sum, every) if s <= room)


@pytest.mark.parametrize("lengths", [[1], [4096], [8192, 1], [4095] * 3, [4000] * 50 + [90] * 3, "random"])
def test_plans_place_every_id_once(lengths):
    random.seed(1)
    lengths = [random.choice([1, random.randrange(1, 300), random.randrange(1, 9000)]) for _ in range(3000)] if lengths == "random" else lengths
    found: dict = {}
    for pieces in P.plan(lengths):
        n = sum(x for _, _, x in pieces)
        assert n == P.WINDOW or n & (n - 1) == 0 and n < P.WINDOW
        for d, at, x in pieces:
            assert x > 0
            found.setdefault(d, []).append((at, x))
    for d, n in enumerate(lengths):
        at = 0
        for start, x in sorted(found[d]):
            assert start == at
            at += x
        assert at == n


def test_round_trip(spark, documents, tokenizer, monkeypatch):
    rows = P.packed(documents.repartition(3), PATH).collect()
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in documents.collect()}
    sequences: dict = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= 4096
        assert at == 4096 or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(map(len, want.values()))

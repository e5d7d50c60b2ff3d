import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import textcore as X
from heddle.llm.bloom import Bloom, _parts
from llm_helpers import SPACED, lower, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abcABC019é \t\n\x0b\x0c\r.-_~\x1c\x85ß漢", max_size=40)), max_size=12)


@given(TEXTS, st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_words_are_the_patterns_matches(values, most_bytes):
    for kind, low, want in ((X.LOWER_WORDS, True, words), (X.SPACED_WORDS, False, lambda t: SPACED.findall(t or ""))):
        got = []
        for a, b, texts in X.slices(pa.array(values, pa.string()), most_bytes):
            w = X.words(texts, kind, low)
            found = [x.decode() for x in X.strings(w)]
            got += [found[w.first[i] : w.first[i + 1]] for i in range(b - a)]
        assert got == [want(t) for t in values]


@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=30), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_hashes_follow_words(values):
    (_, _, texts), = X.slices(pa.array([" ".join(values)]), 1 << 20)
    w = X.words(texts, X.SPACED_WORDS)
    h = X.hashes(w).tolist()
    assert [h[i] == h[j] for i in range(len(h)) for j in range(len(h))] == [a == b for a in values for b in values]
    every = np.arange(len(h))
    assert X.same_words(w, every, w, every)
    assert X.same_words(w, every[:1], w, every[-1:]) == (values[0] == values[-1])


def test_slices_of_a_sliced_column_with_nulls():
    column = pa.array(["zero", None, "a b", "", "c"]).slice(1)
    parts = [(a, b, X.words(t, X.SPACED_WORDS).counts.tolist()) for a, b, t in X.slices(column, 2)]
    assert [n for _, _, c in parts for n in c] == [0, 2, 0, 1]
    assert list(X.slices(pa.array([], pa.string()))) == []
    assert lower("ÀB") == "Àb"


@pytest.mark.parametrize("power", [20, 22])
def test_a_bloom_filter_has_all_it_was_given(power):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 5000, np.uint64)
    bits = np.zeros(1 << (power - 3), np.uint8)
    for batch in _parts(power)(iter([pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])])):
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            each = 1 << (power - 11)
            bits[part * each : (part + 1) * each] |= np.frombuffer(raw, np.uint8)
    bloom = Bloom(bits.tobytes(), power)
    assert bloom.may_hold(h).all()
    assert bloom.may_hold(rng.integers(0, 2**64, 20000, np.uint64)).mean() < 0.01

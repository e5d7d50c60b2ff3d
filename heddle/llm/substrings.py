"""Substring dedup by automata of repeated phrases.

A window is 13 words in a row. Each window has an anchor, the five-gram of least
hash in it, so that equal windows have equal anchors, and neighbouring windows
mostly share one. Windows in a row with one anchor make a segment.

1. Anchors are counted over the corpus, summed in each task first; those in two
   documents or more recur. They are sent to the executors as a Bloom filter of
   bounded size, whose false positives cost work but change nothing.
2. Documents are read again. Each segment whose anchor may recur is entered once
   for each block of documents that holds it, and once in a task with its words.
   Segments of hot anchors (``Limits.hot`` segments or more, told by a second Bloom
   filter) are entered window by window, under the window's own hash, so that no
   anchor gathers an unbounded group.
3. Recurring passages are confirmed: windows of a key are grouped by hash, with all
   words compared byte by byte, which tells the windows that recur in two documents
   and the least document that holds each. Their longest runs are the phrases.
4. Phrases are sent to the blocks that may lose words by them, by a join that can
   split hot keys. A block's phrases are compiled to an Aho-Corasick automaton, or
   to several of bounded size, and all documents of the block are streamed whole
   through it. It alone locates the occurrences: a document loses the words of
   every phrase found in it that a lesser document holds.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, unchanged.

A filter that is full, as by over some 10^9 recurring anchors, lets all segments
through, which costs a shuffle of a few times the corpus and is still linear in it.

Defined results: a null or wordless text has no words; a text of under 13 words
loses none; very long texts are streamed whole, so a task's memory follows its
longest text, some thirty bytes for each of its bytes; documents of a null id lose
nothing and take nothing from others; documents of one id take nothing from each
other, as neither id is less; repeated rows have a row each; an empty table gives
no rows. Only the two named columns are looked at, so other columns' names can't
clash. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textcore as X
from .store import dropped, written

WINDOW, ANCHOR = 13, 5
#: Letters of the automata: a word's number is written in digits of this base, as an automaton's step takes as long as its node has edges.
DIGITS = 256


@dataclass(frozen=True)
class Limits:
    """How much is done at once. No result depends on it."""

    #: Segments of an anchor from which on they are entered window by window, and the Bloom filters' size as a power of two.
    hot: int = 2_000
    most_bits: int = bloom.MOST_BITS
    #: Bytes of the texts of a block of documents, and words of the phrases of an automaton.
    block_bytes: int = 1 << 20
    automaton_words: int = 400_000
    #: Anchors, and bytes of segments, that a task sums up before it hands them on; bytes of segments that are confirmed at once.
    summed: int = 1_500_000
    merged_bytes: int = 24 << 20
    shard_bytes: int = 8 << 20


_U = np.uint64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def segments(w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: anchor hash, first word, and number of windows."""
    ok = X.within(w.first, WINDOW)
    m = len(ok)
    if not ok.any():
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = X.ngrams(h, ANCHOR)
    best, place = g[:m].copy(), np.zeros(m, np.int8)
    for t in range(1, WINDOW - ANCHOR + 1):
        x = g[t : t + m]
        less = x < best
        best[less] = x[less]
        place[less] = t
    s = np.flatnonzero(ok)
    anchor = s + place[s]
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    return g[anchor[at]], s[at], np.diff(np.append(at, len(s)))


class Rolling:
    """Hashes of any runs of a slice's words."""

    def __init__(self, h: np.ndarray, base: np.uint64):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(h), base))
            self.total = np.concatenate([np.zeros(1, _U), np.cumsum(h * powers, dtype=_U)])
            self.back = np.cumprod(np.full(len(h) + 1, _U(pow(int(base), -1, 2**64))))

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return X.mix((self.total[start + size] - self.total[start]) * self.back[start] + size.astype(_U))


# ---- 1: recurring anchors


def _summed(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes with the least and greatest document and the number of entries."""
    by = np.argsort(h, kind="stable")
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return h[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), np.diff(np.append(at, len(h)))


def _anchors(summed: int):
    """Of ids and texts: sums by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def done() -> pa.RecordBatch:
            columns = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["h", "lo", "hi", "n"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, texts in X.slices(batch.column(1)):
                w = X.words(texts, X.SPACED_WORDS)
                h, start, _ = segments(w, X.hashes(w))
                held.append((h, ids[a + w.owners()[start]] if len(start) else np.zeros(0, np.int64)))
                size += len(h)
                if size >= summed:
                    yield done()
                    held, size = [], 0
        if size:
            yield done()

    return X.lean(run)


# ---- 2: segments

_FOUND = "block long, key long, seg long, lo long, hi long, text binary, kind byte"
_NAMES = ["block", "key", "seg", "lo", "hi", "text", "kind"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int8()]
#: Kinds of rows: a segment in a block, and a segment with its words.
_PLACE, _WORDING = 1, 2


def _batch(kind: int, **columns) -> pa.RecordBatch:
    n = len(columns["key"])
    columns["kind"] = np.full(n, kind, np.int8)
    arrays = [pa.array(columns[c].view(np.int64) if getattr(columns[c], "dtype", None) == _U else columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _raw(w: X.Words, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes from the first to the last word of runs of words."""
    a, b = w.start[start], w.end[start + size - 1]
    ends = np.cumsum(b - a)
    at = np.repeat(a - (ends - (b - a)), b - a) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends])
    large = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(w.data[at])])
    return large.cast(pa.binary())


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _merged(key: np.ndarray, seg: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: pa.Array, ordered: bool) -> tuple:
    """One row for each segment, with its least and greatest holder."""
    if not ordered:
        by = np.lexsort((seg, key))
        key, seg, lo, hi, text = key[by], seg[by], lo[by], hi[by], text.take(pa.array(by))
    at = _runs(key, seg)
    if len(at) == len(key):
        return key, seg, lo, hi, text
    return key[at], seg[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), text.take(pa.array(at))


def _wordings(held: list[tuple]) -> pa.RecordBatch:
    key, seg, lo, hi = (np.concatenate([x[k] for x in held]) for k in range(4))
    key, seg, lo, hi, text = _merged(key, seg, lo, hi, pa.concat_arrays([x[4] for x in held]), ordered=False)
    return _batch(_WORDING, key=key, seg=seg, lo=lo, hi=hi, text=text)


def _finder(sent, merged_bytes: int):
    """Of ids, blocks and texts: rows of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hot = sent.value
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, texts in X.slices(batch.column(2)):
                w = X.words(texts, X.SPACED_WORDS)
                h = X.hashes(w)
                key, start, n = segments(w, h)
                good = seen.may_hold(key)
                key, start, n = key[good], start[good], n[good]
                if not len(key):
                    continue
                owner = a + w.owners()
                one, two = Rolling(h, _BASE), Rolling(h, _BASE_2)
                is_hot = hot.may_hold(key)
                if is_hot.any():
                    # window by window
                    first = np.repeat(start[is_hot], n[is_hot]) + _counting(n[is_hot])
                    key = np.concatenate([key[~is_hot], one.of(first, np.full(len(first), WINDOW))])
                    start = np.concatenate([start[~is_hot], first])
                    n = np.concatenate([n[~is_hot], np.ones(len(first), np.int64)])
                seg = two.of(start, n + WINDOW - 1)
                doc, block = ids[owner[start]], blocks[owner[start]]
                by = np.lexsort((seg, key, block))
                at = _runs(block[by], key[by], seg[by])
                yield _batch(_PLACE, block=block[by[at]], key=key[by[at]], seg=seg[by[at]], hi=np.maximum.reduceat(doc[by], at))
                # a segment that the texts of one task hold many times is sent on once
                raw = _raw(w, start, n + WINDOW - 1)
                held.append((key, seg, doc, doc, raw))
                size += raw.nbytes
                if size >= merged_bytes:
                    yield _wordings(held)
                    held, size = [], 0
        if held:
            yield _wordings(held)

    return X.lean(run)


def _counting(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, then 0 to n[1] - 1, and so on."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n)


# ---- 3: confirmed passages


def _numbers(w: X.Words) -> np.ndarray:
    """Words as numbers, equal exactly where their bytes are."""
    h = X.hashes(w)
    _, example, number = np.unique(h, return_index=True, return_inverse=True)
    if not X.same_words(w, np.arange(len(h)), w, example[number]):
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(x, len(seen)) for x in X.strings(w)])
    return number.astype(np.int64)


def _held(ids: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest holder of the words of each window, from those of all windows with the same words."""
    for seed in range(64):
        h = X.ngrams(X.mix(ids.astype(np.uint64) + _U(seed << 40)), WINDOW)[start]
        by = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[by[1:]] != h[by[:-1]]
        group, at = np.cumsum(new) - 1, np.flatnonzero(new)
        example = start[by[at]][group]
        if all(np.array_equal(ids[start[by] + k], ids[example + k]) for k in range(WINDOW)):
            least, most = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
            least[by], most[by] = np.minimum.reduceat(lo[by], at)[group], np.maximum.reduceat(hi[by], at)[group]
            return least, most
    raise RuntimeError("windows share hashes under every seed")


def confirmed(texts: X.Texts, key: np.ndarray, seg: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Phrases of rows sorted by key and segment, which hold all segments of their keys.

    A phrase is the longest run of a segment's windows that recur in the same least and greatest document. Returns the
    segments with phrases by their first rows, the number of phrases of each, and the phrases' least holders and bytes.
    """
    w = X.words(texts, X.SPACED_WORDS)
    numbers = _numbers(w)
    rows = _runs(key, seg)
    # rows of one segment, out of several tasks, become one
    lo, hi = np.minimum.reduceat(lo, rows), np.maximum.reduceat(hi, rows)
    n = w.counts[rows] - WINDOW + 1
    of = np.repeat(np.arange(len(rows)), n)
    start = w.first[:-1][rows][of] + _counting(n)
    least, most = _held(numbers, start, lo[of], hi[of])
    recurs = least < most
    new = recurs.copy()
    new[1:] &= ~(recurs[:-1] & (of[1:] == of[:-1]) & (least[1:] == least[:-1]) & (most[1:] == most[:-1]))
    begin = np.flatnonzero(new)
    # a run ends before the next one, or the next window that doesn't recur
    stop = np.flatnonzero(np.append(new[1:] | ~recurs[1:], True) & recurs)
    at = _runs(of[begin])
    return rows[of[begin[at]]], np.diff(np.append(at, len(begin))), least[begin], _raw(w, start[begin], start[stop] - start[begin] + WINDOW)


def _confirmer(shard_bytes: int):
    """Of segments sorted by key: their phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            key, seg, lo, hi = (part.column(c).to_numpy() for c in ("key", "seg", "lo", "hi"))
            (_, _, texts), *more = X.slices(part.column("text").cast(pa.large_binary()).combine_chunks().view(pa.large_string()), most_bytes=1 << 40)
            assert not more
            at, n, least, text = confirmed(texts, key, seg, lo, hi)
            phrases = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([pa.array(least), text], ["least", "text"]))
            return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(seg[at]), phrases], names=["key", "seg", "phrases"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, seg, lo, hi = (batch.column(c).to_numpy() for c in ("key", "seg", "lo", "hi"))
            key, seg, lo, hi, text = _merged(key, seg, lo, hi, batch.column("text"), ordered=True)
            batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.array(lo), pa.array(hi), text], names=["key", "seg", "lo", "hi", "text"])
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                whole = pa.Table.from_batches(held)
                keys = whole.column("key").to_numpy()
                # up to the last key, of which more may come
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                if cut:
                    yield done(whole.slice(0, cut))
                held, size = whole.slice(cut).combine_chunks().to_batches(), 0
        if held and any(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held))

    return X.lean(run)


# ---- 4: automata


class Phrases:
    """Phrases compiled to Aho-Corasick automata. Letters are the digits of the words' numbers, 0 being any other word."""

    def __init__(self, texts: X.Texts, least: np.ndarray, most_words: int):
        w = X.words(texts, X.SPACED_WORDS)
        for self.seed in range(64):
            h = X.hashes(w, self.seed)
            self.vocabulary, example, number = np.unique(h, return_index=True, return_inverse=True)
            if X.same_words(w, np.arange(len(h)), w, example[number]):
                break
        else:
            raise RuntimeError("words share hashes under every seed")
        self.words, self.example = w, example
        self.n_digits = 1
        while DIGITS**self.n_digits <= len(self.vocabulary):
            self.n_digits += 1
        letters = self._letters(number + 1)
        self.automata: list[tuple[ahocorasick.Automaton, np.ndarray, np.ndarray]] = []
        sizes, first, at = w.counts, (w.first * self.n_digits).tolist(), 0
        ends = np.cumsum(sizes)
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_words, side="right")))
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for i in range(at, to):
                # equal phrases have the same least holder
                automaton.add_word(tuple(letters[first[i] : first[i + 1]]), i)
            automaton.make_automaton()
            self.automata.append(automaton)
            at = to
        self.sizes, self.least = sizes, least

    def _letters(self, numbers: np.ndarray) -> list[int]:
        k = self.n_digits
        out = np.empty((len(numbers), k), np.int64)
        for j in range(k):
            out[:, j] = numbers // DIGITS ** (k - 1 - j) % DIGITS + j * DIGITS
        return out.reshape(-1).tolist()

    def located(self, w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences in the texts of w: first words, numbers of words, and least holders."""
        h = X.hashes(w, self.seed)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        known = known[X.alike(w, known, self.words, self.example[at[known]])]
        numbers = np.zeros(len(h), np.int64)
        numbers[known] = at[known] + 1
        # another word between two texts, so that no phrase goes across
        cuts = w.first[1:-1]
        back = np.insert(np.arange(len(h)), cuts, -1)
        stream = tuple(self._letters(np.insert(numbers, cuts, 0)))
        found = [np.array(list(a.iter(stream)), np.int64).reshape(-1, 2) for a in self.automata]
        end, phrase = np.concatenate(found).T
        size = self.sizes[phrase]
        return back[end // self.n_digits] - size + 1, size, self.least[phrase]


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>, kept string"
_PIECES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed(phrases: Phrases | None, ids: pa.Array, values: pa.Array, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """A block's documents, all streamed through its automata."""
    null, doc = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
    for a, b, texts in X.slices(values):
        w = X.words(texts, X.SPACED_WORDS)
        gone = np.zeros(len(w.start), bool)
        if phrases is not None:
            start, size, least = phrases.located(w)
            owner = a + w.owners()
            less = ~null[owner[start]] & (least < doc[owner[start]])
            edge = np.zeros(len(gone) + 1, np.int64)
            np.add.at(edge, start[less], 1)
            np.add.at(edge, start[less] + size[less], -1)
            gone = np.cumsum(edge)[:-1] > 0
        n_removed = X.sums(gone, w.first)
        raw, out = texts.data.tobytes(), []
        for i, (x, y) in enumerate(zip(texts.offs.tolist(), texts.offs[1:].tolist(), strict=False)):
            words, pieces = raw[x:y].split(), []
            if n_removed[i]:
                own = gone[w.first[i] : w.first[i + 1]]
                words = [word for word, g in zip(words, own.tolist(), strict=True) if not g]
                pieces = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept = b" ".join(words)
            out.append((hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in pieces], kept.decode() if keep_text else None))
        sha, pieces, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(w.counts), pa.array(n_removed), pa.array(sha), pa.array(pieces, _PIECES), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"])


def _streamer(keep_text: bool, automaton_words: int):
    """Of rows sorted by ``at``, which is even for a block's phrases and odd for its documents: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, phrases = None, [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = [*_runs(at).tolist(), len(at)] if len(at) else []
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if at[a] >> 1 != block:
                    block, held, phrases = at[a] >> 1, [], None
                if not at[a] & 1:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    ((_, _, texts),) = X.slices(whole.column("text").cast(pa.large_string()).combine_chunks(), most_bytes=1 << 40)
                    phrases, held = Phrases(texts, whole.column("doc").to_numpy(), automaton_words), []
                yield from _removed(phrases, part.column(1), part.column(2), keep_text)

    return X.lean(run)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A row for each document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``removed`` (runs of removed
    words as start and end) and, if ``keep_text``, ``kept``, the kept words joined by one space."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = docs.where("doc is not null")
    anchors = known.mapInArrow(_anchors(limits.summed), "h long, lo long, hi long, n long")
    recurring = anchors.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("h", "n")
    recurring = written(recurring, "anchors")
    sent = spark.sparkContext.broadcast((bloom.of(recurring, "h", limits.most_bits), bloom.of(recurring.where(F.col("n") >= limits.hot), "h", limits.most_bits)))
    dropped(recurring)

    # blocks are by id and text, so that neither null ids nor copies gather in one
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc", "text"), F.lit(total // limits.block_bytes + 1))
    found = written(known.select("doc", block.alias("block"), "text").mapInArrow(_finder(sent, limits.merged_bytes), _FOUND), "segments", by="kind")
    sent.destroy()
    wordings = found.where(F.col("kind") == _WORDING).select("key", "seg", "lo", "hi", "text").repartition("key").sortWithinPartitions("key", "seg")
    phrases = written(wordings.mapInArrow(_confirmer(limits.shard_bytes), "key long, seg long, phrases array<struct<least:bigint,text:binary>>"), "phrases")
    dropped(found, f"kind={_WORDING}")

    # both sides grow with the corpus, and so are merged and never broadcast
    places = found.where(F.col("kind") == _PLACE).select("block", "key", "seg", "hi")
    sent_on = places.join(phrases.hint("merge"), ["key", "seg"]).select("block", F.explode(F.filter("phrases", lambda p: p.least < F.col("hi"))).alias("p"))
    sent_on = sent_on.select((F.col("block") * 2).alias("at"), F.col("p.least").alias("doc"), F.col("p.text").cast("string").alias("text"))
    both = sent_on.union(docs.select((block * 2 + 1).alias("at"), "doc", "text"))
    both = both.repartition((F.col("at") / 2).cast("long")).sortWithinPartitions("at")
    out = both.mapInArrow(_streamer(keep_text, limits.automaton_words), _OUT)
    return out if keep_text else out.drop("kept")

"""Packing of token sequences by minimum bin slack.

Texts become token ids, and a document's ids are cut into whole windows and a
rest. Rests are kept as counts of lengths. A window begins with the longest rest
left; a bitset subset-sum programme over the remaining lengths then finds the
multiset that comes closest to the window's capacity, and its counts are
backtracked from the bitsets. A multiset is used as often as the counts allow.
Where even the closest leaves room while rests are left, one of them is cut to
fill it. What is left at the end of a group is cut into sequences whose lengths
are powers of two, which need no padding.

A group is a bounded run of documents in the order in which a task reads them,
so that a task needs bounded memory, nothing is shuffled, and a repeated task
makes the same sequences. A group costs at most a dozen short sequences.

Tokenizing splits texts at ASCII white space, at which no token of a tokenizer
that drops white space crosses, and keeps the ids of words that were seen.

Defined results: a null or empty text has the closing id alone; a very long text is
tokenized whole, in some forty bytes for each of its bytes, and fills windows of its
own; of rests alike in length the first read is taken first; repeated documents are
packed each; an empty table gives no rows; only the two named columns are looked at,
so no other can clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X

WINDOW = 4096
#: Tokens of a group, counted before its last slice of texts.
GROUP_TOKENS = 4 << 20
#: Words whose ids a Python worker keeps, and bytes of the longest of them.
CACHE_WORDS, CACHE_BYTES = 1_600_000, 64
#: Bytes of texts whose ids are made at once.
SLICE_BYTES = 4 << 20

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class WordIds:
    """Token ids of words, kept for the words that are seen again."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self._clear()

    def _clear(self) -> None:
        self.h = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.words = X.Words(np.zeros(8, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(2, np.int64))
        self.word = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)

    def _make_room(self) -> None:
        """Forget the words that were seen in one slice of texts only, or all if most were seen in more."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHE_WORDS // 2:
            self._clear()
            return
        n, at = self.n[kept], self.at[kept]
        ends = np.cumsum(n, dtype=np.int64)
        ids = self.ids[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        a, b = self.words.start[self.word[kept]], self.words.end[self.word[kept]]
        stop = np.cumsum(b - a, dtype=np.int64)
        data = self.words.data[np.repeat(a - (stop - (b - a)), b - a) + np.arange(int(stop[-1]) if len(stop) else 0)]
        self.words = X.Words(np.concatenate([data, np.zeros(8, np.uint8)]), (stop - (b - a)).astype(np.int32), stop.astype(np.int32), self.words.first)
        self.h, self.at, self.n, self.ids = self.h[kept], (ends - n).astype(np.int32), n, ids
        self.word, self.uses = np.arange(len(kept), dtype=np.int32), np.ones(len(kept), np.int32)

    def _encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        ids, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        # the tokenizer's own records of a word take much more room than its ids
        for at in range(0, len(found), 20_000):
            part = [x.decode(errors="replace") for x in found[at : at + 20_000]]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            n.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(n)

    def _learn(self, w: X.Words, h: np.ndarray, words: np.ndarray) -> None:
        raw = w.data.tobytes()
        found = [raw[a:b] for a, b in zip(w.start[words].tolist(), w.end[words].tolist(), strict=True)]
        ids, n = self._encode(found)
        ends, size = np.cumsum(n), np.array([len(x) for x in found], np.int64)
        base = len(self.words.data) - 8
        data = np.concatenate([self.words.data[:base], np.frombuffer(b"".join(found), np.uint8), np.zeros(8, np.uint8)])
        start = base + np.cumsum(size) - size
        k = len(self.words.start)
        self.words = X.Words(data, np.concatenate([self.words.start, start.astype(np.int32)]), np.concatenate([self.words.end, (start + size).astype(np.int32)]), self.words.first)
        at = np.searchsorted(self.h, h)
        self.at, self.n = np.insert(self.at, at, len(self.ids) + ends - n), np.insert(self.n, at, n)
        self.word, self.uses, self.h = np.insert(self.word, at, k + np.arange(len(h))), np.insert(self.uses, at, 0), np.insert(self.h, at, h)
        self.ids = np.concatenate([self.ids, ids])

    def tokens(self, texts: X.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        w = X.words(texts, X.SPACED_WORDS)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        h = X.hashes(w)
        unique, first, each = np.unique(h, return_index=True, return_inverse=True)
        if len(self.h) + len(unique) > CACHE_WORDS:
            self._make_room()
        at = np.minimum(np.searchsorted(self.h, unique), max(0, len(self.h) - 1))
        known = self.h[at] == unique if len(self.h) else np.zeros(len(unique), bool)
        if not X.same_words(w, first[known], self.words, self.word[at[known]]):
            self._clear()  # a hash of two words: start anew with these
            known[:] = False
        short = w.end[first] - w.start[first] <= CACHE_BYTES
        new = ~known & short
        if new.any():
            self._learn(w, unique[new], first[new])
        at = np.minimum(np.searchsorted(self.h, unique), max(0, len(self.h) - 1))
        ids, place, n = self.ids, np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        if len(self.h):
            place[short], n[short] = self.at[at[short]], self.n[at[short]]
            self.uses[at[short]] += 1
        if not short.all():
            long = first[~short]
            more, size = self._encode([w.data[w.start[j] : w.end[j]].tobytes() for j in long])
            place[~short], n[~short] = len(ids) + np.cumsum(size) - size, size
            ids = np.concatenate([ids, more])
        count = n[each]
        ends = np.cumsum(count)
        from_ = np.repeat(place[each] - (ends - count), count) + np.arange(int(ends[-1]))
        return ids[from_], np.concatenate([[0], ends])[w.first]


_CACHE: dict[int, WordIds] = {}


def word_ids(config: str) -> WordIds:
    """This worker's tokenizer for a configuration."""
    key = zlib.crc32(config.encode())
    if key not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHE.clear()
        _CACHE[key] = WordIds(Tokenizer.from_str(config))
    return _CACHE[key]


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of the multiset of lengths whose sum is the greatest up to ``room``.

    Bit s of ``reach`` says that some multiset of the lengths so far has the sum s. A length is offered in lots of 1, 2,
    4, ... copies, which make up every count. It stops when ``room`` itself is reached.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left and not reach >> room:
            lot = min(lot, left)
            steps.append((reach, length, lot))
            reach |= (reach << (length * lot)) & mask
            left -= lot
            lot *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for before, length, lot in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + lot
            total -= length * lot
    return out


def plan(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, first id, ids); ``lengths`` are the documents' ids, each at least 1."""
    out, rests = [], {}
    for d, n in enumerate(lengths):
        out += [[(d, at, window)] for at in range(0, n - window + 1, window)]
        if n % window:
            rests.setdefault(n % window, []).append((d, n - n % window))
    counts = {x: len(y) for x, y in rests.items()}
    total = sum(x * n for x, n in counts.items())

    def take(length: int) -> tuple[int, int, int]:
        d, at = rests[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length], rests[length]
        return d, at, length

    while total >= window:
        top = max(counts)
        counts[top] -= 1
        chosen = closest({x: n for x, n in counts.items() if n}, window - top)
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        full = sum(x * n for x, n in chosen.items())
        times = min(counts[x] // n for x, n in chosen.items()) if full == window else 1
        for _ in range(times):
            out.append([take(x) for x in sorted(chosen, reverse=True) for _ in range(chosen[x])])
        if full < window:
            # no multiset fills it: cut the shortest rest that is long enough
            room = window - full
            d, at, length = take(min(x for x in counts if x > room))
            out[-1].append((d, at, room))
            rests.setdefault(length - room, []).append((d, at + room))
            counts[length - room] = counts.get(length - room, 0) + 1
        total -= times * window
    left = [take(x) for x in sorted(counts, reverse=True) for _ in range(counts[x])]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            d, at, length = left.pop()
            used = min(length, room)
            out[-1].append((d, at, used))
            if used < length:
                left.append((d, at + used, length - used))
            room -= used
    return out


def _packer(config, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, names, sequence = word_ids(config.value), None, TaskContext.get().partitionId() << 32
        group: list = []
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal sequence
            docs, rows = [d for part in group for d in part[1]], []
            for pieces in plan([len(x) for x in docs], window):
                at, total = 0, sum(n for _, _, n in pieces)
                for d, start, n in pieces:
                    rows.append((d, start, n, zlib.crc32(docs[d][start : start + n].tobytes()), len(docs[d]), sequence, at, total))
                    at += n
                sequence += 1
            ids = pa.concat_arrays([part[0] for part in group])
            table = np.array(rows, np.int64).reshape(-1, 8)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 8))], names=names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
        for batch in batches:
            for a, b, texts in X.slices(batch.column(1), most_bytes=SLICE_BYTES):
                ids, at = cache.tokens(texts)
                # a copy for each document with its closing id
                group.append((batch.column(0).slice(a, b - a), [np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4") for i in range(b - a)]))
                size += len(ids) + b - a
                if size >= GROUP_TOKENS:
                    yield emit()
                    group, size = [], 0
        if group:
            yield emit()

    return X.lean(run)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """A row for each piece: its document, place there, CRC-32 of its ids, and place in its sequence.

    ``tokenizer`` is the path of a tokenizer's JSON file, which drops white space. It is read here and sent to the
    executors. Sequences are full, or as long as a power of two.
    """
    with open(tokenizer, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(config, end_id, window), PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))

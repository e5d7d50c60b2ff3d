"""Vectorised word handling over Arrow text columns.

Texts stay UTF-8 bytes. Every word class used in this subpackage is exact on
bytes: its ASCII members are listed and all bytes of non-ASCII characters are
word bytes (``LOWER_WORDS``) or the separators are all ASCII
(``SPACED_WORDS``). Nothing here needs Spark.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text.
LOWER_WORDS = np.zeros(256, dtype=bool)
LOWER_WORDS[0x30:0x3A] = LOWER_WORDS[0x61:0x7B] = LOWER_WORDS[0x80:] = True
#: ``[^\x20\x09-\x0D]``.
SPACED_WORDS = np.ones(256, dtype=bool)
SPACED_WORDS[[0x20, *range(0x09, 0x0E)]] = False

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_STEP = _U(0x9E3779B97F4A7C15)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper that gives memory back when its task is done, as a Python worker lives on for tasks of other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps what it has
            pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@dataclass
class Texts:
    """Some texts in one buffer: text i is ``data[offs[i]:offs[i + 1]]``. The buffer has eight more bytes."""

    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1


@dataclass
class Words:
    """Word j is ``data[start[j]:end[j]]``; text i has the words ``first[i]`` to ``first[i + 1] - 1``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if values.null_count:
        values = values.fill_null("")
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    _, at, data = values.buffers()
    offs = np.frombuffer(at, kind, len(values) + 1, values.offset * kind().itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(values: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``most_bytes``; a longer text is a run of its own."""
    data, offs = column(values)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most_bytes, side="right")) - 1)
        part = np.zeros(offs[to] - offs[at] + 8, np.uint8)
        part[:-8] = data[offs[at] : offs[to]]
        yield at, to, Texts(part, offs[at : to + 1] - offs[at])
        at = to


def words(texts: Texts, kind: np.ndarray, lower: bool = False) -> Words:
    """The maximal runs of bytes of a class, never across two texts."""
    data, offs = texts.data, texts.offs
    if lower:
        data = LOWER[data]
    n = int(offs[-1])
    inside = kind[data[:n]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    at = offs[:-1][full]
    begins[at] = inside[at]
    at = offs[1:][full] - 1
    ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offs))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number. The last eight bytes of ``data`` are padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, never 0."""
    eight, size = loads(w.data), w.end - w.start
    with np.errstate(over="ignore"):
        h = mix(size.astype(_U) * _STEP + _U(seed))
        h = mix(h ^ (eight[w.start] & _KEEP[np.minimum(size, 8)]))
        left = np.flatnonzero(size > 8)
        at = 8
        while len(left):
            more = eight[w.start[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]
            h[left] = mix((h[left] + _STEP) ^ more)
            at += 8
            left = left[size[left] > at]
    h[h == 0] = 1
    return h


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> bool:
    """Whether word ``i[k]`` of a has the bytes of word ``j[k]`` of b, for every k."""
    size = a.end[i] - a.start[i]
    if not np.array_equal(size, b.end[j] - b.start[j]):
        return False
    x, y, at = loads(a.data), loads(b.data), 0
    while len(i):
        keep = _KEEP[np.minimum(size - at, 8)]
        if np.any((x[a.start[i] + at] ^ y[b.start[j] + at]) & keep):
            return False
        at += 8
        more = size > at
        i, j, size = i[more], j[more], size[more]
    return True


def alike(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """For every k, whether word ``i[k]`` of a has the bytes of word ``j[k]`` of b."""
    size = a.end[i] - a.start[i]
    out = size == b.end[j] - b.start[j]
    x, y, at, left = loads(a.data), loads(b.data), 0, np.flatnonzero(out)
    while len(left):
        keep = _KEEP[np.minimum(size[left] - at, 8)]
        same = (x[a.start[i[left]] + at] ^ y[b.start[j[left]] + at]) & keep == 0
        out[left[~same]] = False
        at += 8
        left = left[same & (size[left] > at)]
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, ignoring where texts end; shorter than h by n - 1."""
    if len(h) < n:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, _U)
        for k in range(n):
            out = out * _STEP + h[k : len(h) - n + 1 + k] * _M2
            out ^= out >> _U(29)
        return mix(out)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """For each position of all texts but the last n - 1: whether n words from there on are in one text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in first[1:-1]:
        ok[max(0, k - n + 1) : k] = False
    return ok


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by text, in which empty texts have 0. Each text is summed by itself, whatever stands beside it."""
    out = np.zeros(len(first) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some], dtype=out.dtype)
    return out


def joined(w: Words, i: int) -> bytes:
    """Text i's words with one space between each two."""
    return b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(w.first[i], w.first[i + 1]))


def strings(w: Words) -> list[bytes]:
    """All words as bytes."""
    raw = w.data.tobytes()
    return [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]

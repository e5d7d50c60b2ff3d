"""Benchmark decontamination with suffix arrays over the training texts.

Documents are cut into shards of a bounded number of words. A shard's suffix
array is made by prefix tripling, down to the length of the longest test item,
as no match is longer. Every suffix of every test item is then binary-searched,
which yields its longest verbatim match in the shard with all its places.
Shards are made and searched where the documents are read, so nothing is
shuffled. Test items are sent to the executors in blocks of bounded size, one
pass for each block.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in a text with
A-Z lower-cased. They are compared by a 64-bit hash while searching, and byte by
byte before a match counts; should two words share a hash, the shard is done
again under another seed.

Every shard is searched for every suffix of the items, which is the method's cost:
it grows with the number of shards times the benchmark's words.

Item ids may be of any type that has a text; they are reported as text.

Defined results: a null or wordless text has no words and no hits; a very long text
is cut into shards that overlap by as many words as a match can have, and is held
whole with its words, in some sixty bytes for each of its bytes; a null or wordless
item has no windows; equal texts of two items count for both; items of one id are
one item; a null id counts as an item and is listed as null; of longest matches that
are equally long the one of the first item by id, null first, and then of the first
word counts; repeated documents are rows of their own; empty tables give no rows,
and a benchmark without items leaves every document clean. Columns other than the
two named ones are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as X

WINDOW = 13
#: A document is contaminated if ``SHARE * n_hit >= n_words`` and it has a hit.
SHARE = 20
#: Words of a shard; with as many marks between texts they are under 2^21, as packed ranks need.
SHARD_WORDS = 1_000_000
#: Bytes of the texts that are searched at once, beyond the first.
SLICE_BYTES = 4 << 20
#: Bytes of test items that are broadcast at once; more are done in more passes.
BLOCK_BYTES = 16 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hits", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest_words", T.LongType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("longest_start", T.LongType()),
        T.StructField("longest_order", T.LongType()),
    ]
)


class Items:
    """A block of test items, as words with hashes under a seed. ``order`` is the number of the first among all items."""

    def __init__(self, ids: list[str | None], texts: list[str], order: int, window: int):
        raw = [t.encode() for t in texts]
        data = np.zeros(sum(map(len, raw)) + 8, np.uint8)
        data[:-8] = np.frombuffer(b"".join(raw), np.uint8)
        self.words = X.words(X.Texts(data, np.cumsum([0, *map(len, raw)])), X.LOWER_WORDS, lower=True)
        self.ids, self.order, n = ids, order, self.words.counts
        self.longest = int(n.max(initial=0))
        self.owner = self.words.owners()
        at = np.arange(len(self.owner))
        left = self.words.first[1:][self.owner] - at if len(at) else at
        whole = (at == self.words.first[:-1][self.owner]) if len(at) else at.astype(bool)
        #: Words of the window that starts at each item word, 0 if none does.
        self.width = np.where(left >= window, window, np.where(whole & (n[self.owner] < window), left, 0)) if len(at) else at
        self.left = left
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, seed: int) -> np.ndarray:
        if seed not in self._hashes:
            self._hashes[seed] = X.hashes(self.words, seed)
        return self._hashes[seed]


class SuffixArray:
    """All suffixes of a shard's words in the order of their first ``depth`` words or more.

    ``ids`` are the words' ranks by hash, with the greatest id between documents.
    """

    def __init__(self, h: np.ndarray, depth: int):
        self.vocabulary, first = np.unique(h, return_inverse=True)
        n = len(h)
        self.ids = np.concatenate([first.astype(np.int64) + 1, np.zeros(1, np.int64)])
        rank, at, self.order = self.ids, 1, None
        todo = np.arange(n)
        slots = todo
        order = np.empty(n, np.int64)
        while True:
            # rank[n] is the least; positions beyond the end count as n
            key = (rank[todo] << 42) | (rank[np.minimum(todo + at, n)] << 21) | rank[np.minimum(todo + 2 * at, n)]
            by = np.argsort(key, kind="stable")
            todo, key = todo[by], key[by]
            order[slots] = todo
            new = np.ones(len(todo), bool)
            new[1:] = key[1:] != key[:-1]
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(todo)))
            if at == 1:
                rank = np.zeros(n + 1, np.int64)
            rank[todo] = np.repeat(slots[begin], length) + 1
            at *= 3
            tied = np.repeat(length > 1, length)
            if at >= depth or not tied.any():
                break
            todo, slots = todo[tied], slots[tied]
        self.order = order

    def find(self, ids: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Search the suffixes of ``ids`` (-1: not in the shard), ``left`` words of each.

        Yields for depth 1, 2, ... the suffixes that match at this depth, and the ranges of ``order`` in which.
        """
        n = len(self.order)
        counts = np.bincount(self.ids[:n], minlength=len(self.vocabulary) + 2)
        below = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        who = np.flatnonzero(ids > 0)
        lo, hi, depth = below[ids[who]], below[ids[who] + 1], 1
        while len(who):
            yield depth, who, lo, hi
            go = left[who] > depth
            who, lo, hi = who[go], lo[go], hi[go]
            want = ids[who + depth]
            go = want > 0
            who, lo, hi, want = who[go], lo[go], hi[go], want[go]
            lo, hi = self._bound(lo, hi, depth, want), self._bound(lo, hi, depth, want + 1)
            go = lo < hi
            who, lo, hi = who[go], lo[go], hi[go]
            depth += 1

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        """The first place in each range whose suffix has an id of ``want`` or more at ``depth``."""
        lo, hi, n = lo.copy(), hi.copy(), len(self.order)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.ids[np.minimum(self.order[mid] + depth, n)] < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


def search(w: X.Words, items: Items) -> tuple[np.ndarray, list[set], np.ndarray]:
    """For the texts of w: which words are hit, each text's items, and each text's longest match as (words, order of the item, start)."""
    total, n_texts = int(w.first[-1]), len(w.first) - 1
    hit, found = np.zeros(total, bool), [set() for _ in range(n_texts)]
    best = np.zeros((n_texts, 3), np.int64)
    if not items.longest or not total:
        return hit, found, best
    owner = w.owners()
    overlap = items.longest - 1
    at = 0
    while at < total:
        # shards of whole texts, or parts of a longer text that share as many words as a match can have
        to = min(total, at + SHARD_WORDS)
        if to < total:
            text_start = int(w.first[owner[to]])
            to = text_start if text_start > at else to
        _search_shard(w, at, to, items, owner, hit, found, best)
        if to >= total:
            break
        at = to if to == int(w.first[owner[to]]) else max(at + 1, to - overlap)
    return hit, found, best


def _search_shard(w, at, to, items, owner, hit, found, best) -> None:
    part = X.Words(w.data, w.start[at:to], w.end[at:to], np.array([0, to - at]))
    for seed in range(64):
        h = X.hashes(part, seed)
        here = owner[at:to]
        cuts = np.flatnonzero(here[1:] != here[:-1]) + 1
        # a word of no item between two texts, so that no match goes across
        spaced = np.insert(h, cuts, _U0)
        back = np.insert(np.arange(to - at), cuts, -1)
        array = SuffixArray(spaced, items.longest)
        q = items.hashes(seed)
        ids = np.searchsorted(array.vocabulary, q)
        known = ids < len(array.vocabulary)
        known[known] = array.vocabulary[ids[known]] == q[known]
        ids = np.where(known, ids + 1, -1)
        ends: dict[int, list] = {}
        ranges: dict[int, tuple[int, int]] = {}
        for depth, who, lo, hi in array.find(ids, items.left):
            for j in np.flatnonzero(items.width[who] == depth):
                ranges[int(who[j])] = (int(lo[j]), int(hi[j]))
            for j in np.flatnonzero((items.width[who] > 0) & (items.width[who] <= depth)):
                ends.setdefault(int(who[j]), []).append((depth, int(lo[j]), int(hi[j])))
        places = {j: back[array.order[lo:hi]] for j, (lo, hi) in ranges.items()}
        if not all(
            X.same_words(part, np.repeat(p, items.width[j]) + np.tile(np.arange(items.width[j]), len(p)), items.words, np.tile(j + np.arange(items.width[j]), len(p)))
            for j, p in places.items()
        ):
            continue
        change = np.zeros(to - at + 1, np.int64)
        for j, p in places.items():
            change[p] += 1
            change[p + items.width[j]] -= 1
            for text in np.unique(here[p]).tolist():
                found[text].add(items.ids[items.owner[j]])
            _longest(array, back, here, ends[j], j, items, w, at, best)
        hit[at:to] |= np.cumsum(change)[:-1] > 0
        return
    raise RuntimeError("words share hashes under every seed")


_U0 = np.uint64(0)


def _longest(array, back, here, nested, j, items, w, at, best) -> None:
    """Enter the longest matches of test suffix j: at each depth, the places that match no further."""
    for k, (depth, lo, hi) in enumerate(nested):
        inner = nested[k + 1][1:] if k + 1 < len(nested) else (hi, hi)
        for a, b in ((lo, inner[0]), (inner[1], hi)):
            p = back[array.order[a:b]]
            for text, start in zip(here[p].tolist(), p.tolist(), strict=True):
                new = (depth, -(items.order + int(items.owner[j])), -int(at + start - w.first[text]))
                if new > (best[text][0], -best[text][1], -best[text][2]) or not best[text][0]:
                    best[text] = (new[0], -new[1], -new[2])


def _runs(mask: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _pass(block, column: str, seen: bool):
    """A mapper over whole batches that adds or extends the column ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*block.value)
        for batch in batches:
            names = batch.schema.names
            before = batch.column(len(names) - 1).to_pylist() if seen else [None] * batch.num_rows
            out = []
            for a, b, texts in X.slices(batch.column(names.index(column)), SLICE_BYTES):
                w = X.words(texts, X.LOWER_WORDS, lower=True)
                hit, found, best = search(w, items)
                for i in range(b - a):
                    own, old = hit[w.first[i] : w.first[i + 1]], before[a + i]
                    ids, (words, order, start) = found[i], best[i].tolist()
                    longest = {"longest_words": words, "longest_item": items.ids[order - items.order] if words else None, "longest_start": start if words else None, "longest_order": order if words else None}
                    if old:
                        own = own.copy()
                        for s, e in np.frombuffer(old["hits"], "<i8").reshape(-1, 2):
                            own[s:e] = True
                        ids = ids.union(old["items"])
                        # items of earlier blocks come first
                        if old["longest_words"] >= words:
                            longest = {k: old[k] for k in longest}
                    listed = sorted(ids, key=lambda x: (x is not None, x or ""))
                    out.append({"n_words": len(own), "n_hit": int(own.sum()), "hits": _runs(own).astype("<i8").tobytes(), "items": listed} | longest)
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("longest_words", pa.int64()), ("longest_item", pa.string()), ("longest_start", pa.int64()), ("longest_order", pa.int64())])
            columns = batch.columns[: len(names) - seen]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[f"c{i}" for i in range(len(columns) + 1)])

    return X.lean(run)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int) -> Iterator[tuple[list[str | None], list[str], int]]:
    """The test items by id, in blocks of about ``most_bytes``; never more than one block is on the driver with the next row."""
    ids, texts, size, order = [], [], 0, 0
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t").select(F.col("i").cast("string").alias("i"), "t").toLocalIterator()
    for row in rows:
        if ids and size + len(row.t) > most_bytes:
            yield ids, texts, order
            ids, texts, size, order = [], [], 0, order + len(ids)
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    yield ids, texts, order


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with one more at the end, the struct of FOUND.

    ``hits`` holds pairs of little-endian 64-bit numbers, the runs of hit words as start and end; ``items`` the ids of
    items of which a window occurs, as text; ``longest_*`` the longest verbatim match of a window or more: its words, its
    item, its first word in the document, and its item's number by id.
    """
    spark, names, out, seen = docs.sparkSession, docs.columns, docs, False
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField(f"c{len(fields)}", FOUND)])
    out = docs.toDF(*[f.name for f in fields])
    column = f"c{names.index(text_col)}"
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast((*block, window))
        out, seen = out.mapInArrow(_pass(sent, column, seen), schema), True
    return out


def contaminated(found: str = "found") -> F.Column:
    """Whether there is a hit word, and hit words are a twentieth of all or more."""
    n_hit = F.col(f"{found}.n_hit")
    return (n_hit > 0) & (SHARE * n_hit >= F.col(f"{found}.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each document: its id as ``doc_id``, the fields of FOUND without the runs, and ``contaminated``."""
    rows = matched(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **how).toDF("doc_id", "text", "found")
    return rows.select("doc_id", *[F.col(f"found.{f.name}") for f in FOUND.fields if f.name not in ("hits", "longest_order")], contaminated().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` without the contaminated documents."""
    names = docs.columns
    rows = matched(docs, benchmark, text_col=text_col, **how)
    last = rows.columns[-1]
    return rows.where(~contaminated(last)).drop(last).toDF(*names)

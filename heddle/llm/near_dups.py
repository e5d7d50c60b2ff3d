"""N-gram Jaccard join by MinHash banding, with exact verification.

Texts are sets of word five-grams. Documents of the same words are one class.
Each class has a MinHash signature, cut into bands; the number of bands and rows
is chosen for a target recall at the threshold. Classes are shuffled on band
hashes, and pairs that share a bucket are verified on their full five-gram sets,
each pair in the first band that it shares only. A bucket all of whose pairs
share an earlier band is left out, so most groups are looked at once.

No pair is a row. A bucket is verified in cells of bounded size: a larger bucket
is cut into blocks, and each two blocks make a cell, so that a group of any size
is spread over tasks and still verified whole. A cell yields, for each of its
classes, the number of linked documents and one edge for the groups. Groups are
the connected components of the edges, found by alternating star contractions
whose rounds are written to the shared folder.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased. A
text of one to four words is one gram of all its words. Grams and words are
compared by 64-bit hashes, texts of the same words by 128 bits.

Defined results: a null or wordless text is a group of its own without links; a
very long text is one set of grams, in some sixty bytes for each of its bytes, and
a cell holds at least one; a similarity of exactly the threshold is a link; repeated
documents are copies of each other; a null id is no group's name while another id is
there, and of a group's rows of the least id the one of the least hash of its text is
first; an empty table gives no rows. Only the two named columns are looked at, so
others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textcore as X
from .store import dropped, written

GRAM, THRESHOLD = 5, 0.8
#: The chance that a pair right at the threshold is a candidate, and the hashes that may be spent.
RECALL, MOST_HASHES = 1 - 1e-6, 128
#: Classes and five-grams of a block; a cell has two blocks.
BLOCK_CLASSES, BLOCK_GRAMS = 512, 400_000
_COLUMNS = 4096


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, which let the fewest unlike pairs through, whose bands for the recall can be afforded."""
    best = (1, 1)
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if 0 < miss < 1 else 1
        if bands * rows <= most:
            best = (max(1, bands), rows)
    return best


def grams(w: X.Words, h: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams one after the other, and where each text's begin and end."""
    counts = w.counts
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(int(first[-1]), np.uint64)
    whole = counts >= n
    if whole.any():
        all_ = X.ngrams(h, n)
        at = np.repeat(w.first[:-1][whole] - first[:-1][whole], each[whole])
        place = np.repeat(whole, each)
        out[place] = all_[at + np.flatnonzero(place)]
    for i in np.flatnonzero((counts > 0) & ~whole):
        own = h[w.first[i] : w.first[i + 1]]
        out[first[i]] = X.mix(X.ngrams(own, len(own)) ^ np.uint64(len(own)))[0]
    return out, first


def sequences(w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole sequence of words."""
    with np.errstate(over="ignore"):
        at = X.mix((np.arange(len(h)) - np.repeat(w.first[:-1], w.counts) + 1).astype(np.uint64))
        parts = X.mix(h ^ at), X.mix((h + at) * np.uint64(0xD6E8FEB86659FD93))
        out = []
        for x in parts:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            out.append(total[w.first[1:]] - total[w.first[:-1]])
    return out[0], out[1]


def signatures(g: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each text that has grams; a band's hash tells its number too."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((len(first) - 1, bands), np.uint64)
    if not len(full):
        return out
    starts, rng = first[:-1][full], np.random.default_rng(20240229)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(full), b + 1, np.uint64)
            for _ in range(rows):
                flip, times = rng.integers(0, 2**64, 2, np.uint64)
                key = X.mix(key ^ np.minimum.reduceat((g ^ flip) * (times | np.uint64(1)), starts))
            out[full, b] = key
    return out


def _signer(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in X.slices(batch.column(2)):
                w = X.words(texts, X.LOWER_WORDS, lower=True)
                h = X.hashes(w)
                g, first = grams(w, h)
                one, two = sequences(w, h)
                keys = signatures(g, first, bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(first)), lists],
                    names=["doc_id", "text_key", "one", "two", "grams", "bands"],
                )

    return X.lean(run)


def _sets(sent):
    """The sets of the documents that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(X.mix(batch.column(1).to_numpy().view(np.uint64)))))
            for a, b, texts in X.slices(batch.column(2)):
                w = X.words(texts, X.LOWER_WORDS, lower=True)
                g, first = grams(w, X.hashes(w))
                sets = [np.unique(g[first[i] : first[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "text_key", "set"])

    return X.lean(run)


@X.lean
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(X.mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["h"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common members of each two sets."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    members, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # members of one set only are common to no two
    shared = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    column, owner = shared[number[keep]], owner[keep]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    out = out.astype(np.int64)
    out[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return out


def verified(bands: np.ndarray, band: int, block: np.ndarray, cross: bool, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two classes of a cell are linked, of those pairs that are this cell's to decide."""
    m = len(sets)
    mine = ~np.eye(m, dtype=bool)
    if cross:
        mine &= block[:, None] != block[None, :]
    for k in range(band):
        mine &= bands[:, None, k] != bands[None, :, k]
    size = np.array([len(s) for s in sets])
    less, more = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    mine &= less >= threshold * more
    some = np.flatnonzero(mine.any(axis=1))
    out = np.zeros((m, m), bool)
    if len(some):
        at = np.ix_(some, some)
        common = overlaps([sets[i] for i in some])
        union = size[some][:, None] + size[some][None, :] - common
        # the rounding of a quotient of whole numbers must not decide
        out[at] = mine[at] & (common * 1000 >= round(threshold * 1000) * union)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _verifier(threshold: float):
    def cell(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, copies, block = (table.column(c).to_numpy() for c in ("class", "copies", "block"))
        if len(ids) < 2:
            return None
        by = np.argsort(ids)
        ids, copies, block = ids[by], copies[by], block[by]
        bands = np.array(table.column("bands").to_pylist(), np.int64)[by]
        sets = [np.frombuffer(table.column("set")[int(i)].as_py(), np.uint64) for i in by]
        lo, hi, band = (table.column(c)[0].as_py() for c in ("lo", "hi", "band"))
        linked = verified(bands, band, block, lo != hi, sets, threshold)
        some = linked.any(axis=1)
        if not some.any():
            return None
        return ids[some], linked[some] @ copies, ids[roots(linked)][some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, out = None, []

        def done() -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["class", "links", "root"])

        for batch in batches:
            cols = np.array([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
            edges = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                now = tuple(cols[:, a].tolist())
                if now != key and held:
                    if (got := cell(held)) is not None:
                        out.append(got)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
            if out:
                yield done()
        if held and (got := cell(held)) is not None:
            out.append(got)
        yield done()

    return X.lean(run)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes of ``edges`` (u, v).

    Large and small stars in turn: each node's neighbours are tied to the least of them, until every edge leads to a
    root. The least is summed in each task first, and joined back by a join that can split a hot node.
    """

    def tied(pairs: DataFrame, name: str) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("least"))
        both = pairs.join(least, "u").withColumn("m", F.least("u", "least"))
        if name == "large":
            out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("least").alias("v")))
        return out.where("u != v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tied(both, "large")
        now, last = written(tied(large.where("v < u"), "small"), "edges"), now
        dropped(last)
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each document: ``doc_id``, ``text_key`` (a hash of its text), ``class_id`` (the least id of the documents
    that links lead to), ``copy_id`` (the least id of the documents of the same words), ``n_links`` (the number of other
    documents of a similarity of ``threshold`` or more), and ``first`` (whether it is the group's one to keep; repeated
    documents are so together, and then ``same`` is over 1).
    """
    spark = docs.sparkSession
    bands, rows = banding(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    signed = written(keyed.mapInArrow(_signer(bands, rows), f"doc_id {kind}, text_key long, one long, two long, grams long, bands array<bigint>"), "signatures")

    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = signed.where("grams > 0").groupBy("one", "two").agg(least.alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    # what is joined from here on grows with the corpus, and so is merged and never broadcast
    held = classes.select("class", "grams", F.posexplode("bands").alias("band", "bucket"))
    shared = written(held.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("grams").alias("weight")).where("n > 1"), "buckets")
    live = written(held.select("class", "band", "bucket").join(shared.hint("merge"), "bucket"), "live")
    dropped(shared)

    even = [(F.min(F.get("bands", F.lit(k))) == F.max(F.get("bands", F.lit(k)))).alias(f"e{k}") for k in range(bands)]
    alike = live.join(classes.select("class", "bands").hint("merge"), "class").groupBy("bucket", "band", "n", "weight").agg(*even)
    # a bucket counts unless all its classes share an earlier band
    earlier = F.array(*[F.col(f"e{k}") for k in range(bands)])
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("weight") / BLOCK_GRAMS)).cast("int")
    own = alike.where(~F.exists(F.slice(earlier, F.lit(1), F.col("band")), lambda x: x)).select("bucket", blocks.alias("blocks"))
    cells = live.select("class", "band", "bucket").join(own.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cells = written(cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class", "bucket", "band", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "cells")
    dropped(live)

    wanted = cells.select("class").distinct().join(classes.select("class", "copies", "bands", "rep").hint("merge"), "class")
    wanted = written(wanted.select("class", "copies", "bands", F.col("rep.doc_id").alias("d"), F.col("rep.text_key").alias("k")), "wanted")
    sent = spark.sparkContext.broadcast(bloom.of(wanted.select("k").mapInArrow(_hashes, "h long"), "h"))
    sets = keyed.mapInArrow(_sets(sent), f"doc_id {kind}, text_key long, set binary")
    sets = sets.join(wanted.hint("merge"), (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # repeated documents give the same set again
    sets = written(sets.select("class", "copies", "bands", "set").dropDuplicates(["class"]), "sets")
    dropped(wanted)
    sent.destroy()

    pairs = cells.join(sets.hint("merge"), "class").select("bucket", "lo", "hi", "band", "block", "class", "copies", "bands", "set")
    pairs = pairs.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    links = written(pairs.mapInArrow(_verifier(threshold), "class long, links long, root long"), "links")
    dropped(cells)
    dropped(sets)

    groups = components(links.select(F.col("class").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("class").agg(F.sum("links").alias("links"))
    all_ = classes.join(counted, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    all_ = all_.select("one", "two", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    named = all_.groupBy("root").agg(F.min("rep").alias("name"))
    all_ = written(all_.join(named, "root").select("one", "two", "rep", "n_links", "name"), "groups")
    for table in (links, classes):
        dropped(table)

    same = signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("same")).where("same > 1")
    out = signed.where("grams > 0").select("doc_id", "text_key", "one", "two").join(all_, ["one", "two"])
    first = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("text_key") == F.col("name.text_key"))
    out = out.select("doc_id", "text_key", F.col("name.doc_id").alias("class_id"), F.col("rep.doc_id").alias("copy_id"), F.col("n_links").cast("long"), first.alias("first"))
    alone = signed.where("grams = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    same = same.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "same")
    return out.where("first").join(same, (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("text_key") == F.col("k")), "left").drop("d", "k").withColumn("same", F.coalesce("same", F.lit(1))).unionByName(out.where("not first").withColumn("same", F.lit(1).cast("long"))).unionByName(alone.withColumn("same", F.lit(1).cast("long")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` that are first in their group; wordless documents all stay."""
    found = written(joined(docs, id_col, text_col, **how).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "first", "same"), "near-dups")
    gone = found.where("not first").select("_d", "_k").distinct()
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    kept = inner.join(gone, key.eqNullSafe(F.col("_k")) & id_.eqNullSafe(F.col("_d")), "left_anti")
    repeated = found.where("same > 1").select("_d", "_k").distinct()
    if repeated.isEmpty():
        return kept.toDF(*names)
    match = key.eqNullSafe(F.col("_k")) & id_.eqNullSafe(F.col("_d"))
    once = kept.join(repeated, match).dropDuplicates(["_d", "_k"]).drop("_d", "_k")
    return kept.join(repeated, match, "left_anti").union(once).toDF(*names)

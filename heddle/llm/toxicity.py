"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the words and word stems in it, a document's the noisy-or of its sentences' scores: it is toxic
unless every sentence is harmless. The weights are learned from labels of
whole documents alone, and the same weights then say which sentences offend.

Only sentences likelier toxic than not (``OFFENDS``) enter a learned model's
noisy-or, or the likeliest one if there is none. The little that each harmless
sentence has would else add up, and any text of enough sentences be toxic.

The fit uses a sample of labelled rows (``MOST_DOCS`` documents, the first by a
hash of the id), whole and of any length. Their features are counted on the
executors, and only the kept ones' counts by sentence come to the driver, equal
sentences of a document once. Scoring reads every whole text where it lies and
shuffles nothing; the model that is broadcast has at most ``MOST_FEATURES``.

Sentences end at ``.``, ``!``, ``?`` or a line feed. Words are the runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased.

Defined results: a null or wordless text has no sentences and the score 0; a very
long text is scored whole, in some sixty bytes for each of its bytes, and no score
depends on other texts or on how rows are dealt; null labels and labels without a
document are not learned from; several labels of a document count by their mean, a
half or more as 1, and of its texts the one of the least hash is learned from;
without any usable label every score is 0; of features alike surprising the lesser hash is taken first; a score of exactly
THRESHOLD is toxic; repeated documents are rows of their own; empty tables give no
rows. Own columns are numbered while texts are scored, so none can clash, and come
last in the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as X
from .store import dropped, written

MOST_DOCS = 8_000
THRESHOLD = 0.7
#: Least score of a sentence that counts in a learned model's noisy-or.
OFFENDS = 0.5
#: Documents of the sample that a feature must be in, and its least likelihood ratio, to get a weight.
LEAST_DOCS, LEAST_RATIO = 3, 8.0
MOST_FEATURES = 4000
#: Features that a task gathers before it sums them.
SUMMED = 1 << 20
#: Bytes of the texts that are looked at at once, beyond the first.
SLICE_BYTES = 2 << 20

_ENDS = np.zeros(256, np.uint8)
_ENDS[[ord(c) for c in ".!?\n"]] = 1

OFFENDING = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", OFFENDING)])


@dataclass
class Model:
    """Sorted feature hashes with a weight each, the score's intercept, and the least score of a sentence that counts."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    least: float = 0.0

    def logits(self, w: X.Words, sentence: np.ndarray, n: int) -> np.ndarray:
        """Logits of the n sentences of all words."""
        z = np.full(n, self.bias)
        for at, word in found(w, self.vocabulary):
            z += np.bincount(sentence[word], self.weights[at], n)
        return z


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def softplus(z: np.ndarray) -> np.ndarray:
    """-log(1 - sigmoid(z)), the share of a sentence in the noisy-or's exponent."""
    return np.logaddexp(0.0, z)


def sentences(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sentences with words, numbered over all texts: the sentence of each word, and the first of each text."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(len(w.first), np.int64)
    gone = np.cumsum(_ENDS[w.data], dtype=np.int64 if len(w.data) >= 1 << 31 else np.int32)
    new = np.ones(len(w.start), bool)
    new[1:] = gone[w.start[1:]] != gone[w.start[:-1]]
    new[w.first[:-1][w.counts > 0]] = True
    sentence = np.cumsum(new) - 1
    return sentence, np.append(sentence, sentence[-1] + 1)[w.first]


#: Kinds of features: 0 is the word, n the first n bytes of a longer word, as its stem.
KINDS = (0, 3, 4, 5, 6, 7)


def features(w: X.Words, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and words of the features of a kind."""
    if not kind:
        return X.hashes(w), np.arange(len(w.start))
    long = np.flatnonzero(w.end - w.start > kind)
    stem = X.Words(w.data, w.start[long], w.start[long] + kind, np.array([0, len(long)]))
    return X.hashes(stem, seed=kind), long


def found(w: X.Words, vocabulary: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind, the places in the vocabulary of the features that are in it, and their words."""
    for kind in KINDS if len(vocabulary) else ():
        h, word = features(w, kind)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == h)
        yield at[known], word[known]


def _summed(h: np.ndarray, n: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each feature."""
    by = np.argsort(h)
    h = h[by]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], np.add.reduceat(n[by], at), np.add.reduceat(bad[by], at)


@X.lean
def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labels and texts: the features, with the numbers of documents and of toxic documents that hold them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def done() -> pa.RecordBatch:
        h, n, bad = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(bad)], names=["h", "n", "bad"])

    for batch in batches:
        y = batch.column(0).to_numpy().astype(np.int64)
        for a, _, texts in X.slices(batch.column(1), SLICE_BYTES):
            w = X.words(texts, X.LOWER_WORDS, lower=True)
            owner = w.owners()
            for kind in KINDS:
                h, word = features(w, kind)
                if not len(h):
                    continue
                doc = owner[word]
                # each feature once for each document
                by = np.lexsort((doc, h))
                h, doc = h[by], doc[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                held.append(_summed(h[new], np.ones(int(new.sum()), np.int64), y[a + doc[new]]))
                size += len(held[-1][0])
            if size >= SUMMED:
                yield done()
                held, size = [], 0
    if size:
        yield done()


def screened(sample: DataFrame, n_docs: int, n_bad: int) -> np.ndarray:
    """Sorted hashes of the features that toxic documents have more often than chance lets expect, the most surprising.

    That is by the likelihood ratio of a feature's share of toxic documents against the share of all.
    """
    n, bad, p = F.col("n"), F.col("bad"), n_bad / n_docs
    counts = sample.select("y", "text").mapInArrow(_counter, "h long, n long, bad long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    share = F.greatest(F.least(bad / n, F.lit(1 - 1e-12)), F.lit(1e-12))
    ratio = 2 * (bad * F.log(share / p) + (n - bad) * F.log((1 - share) / (1 - p)))
    good = counts.where((n >= LEAST_DOCS) & (share > p)).select("h", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    rows = good.orderBy(F.desc("ratio"), "h").limit(MOST_FEATURES).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


BAGS = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("times", "sizes", "words")]])


def _bagger(sent):
    """Of labels and texts: the number of sentences, and the different sets of features in them, with how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            n, times, sizes, words = [np.zeros(0, np.int64)], [], [], []
            for a, b, texts in X.slices(batch.column(1), SLICE_BYTES):
                w = X.words(texts, X.LOWER_WORDS, lower=True)
                sentence, first = sentences(w)
                n.append(np.diff(first))
                at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k, word in found(w, vocabulary):
                    at.append(k)
                    of.append(sentence[word])
                feature, of = np.concatenate(at).astype(np.int32), np.concatenate(of)
                by = np.lexsort((feature, of))
                feature, of = feature[by], of[by]
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
                edges, owner = np.append(begin, len(of)).tolist(), np.searchsorted(first, of[begin], side="right") - 1
                bags: list[Counter] = [Counter() for _ in range(b - a)]
                for i, x, y in zip(owner.tolist(), edges, edges[1:], strict=False):
                    bags[i][feature[x:y].tobytes()] += 1
                for bag in bags:
                    sets = sorted(bag)
                    times.append([bag[x] for x in sets])
                    sizes.append([len(x) // 4 for x in sets])
                    words.append(np.frombuffer(b"".join(sets), np.int32))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(times, lists), pa.array(sizes, lists), pa.array(words, lists)], names=BAGS.names)

    return X.lean(run)


def fit(bags: list, vocabulary: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Weights that make the documents' noisy-or scores likeliest, less a ridge penalty, by Adam over all documents.

    ``bags`` are rows as of BAGS. Sentences without a feature of the vocabulary have the intercept alone.
    """
    y, n_docs = np.array([r.y for r in bags], np.int64), len(bags)
    n = sum(r.n for r in bags)
    if not n or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if n and y.min() == 1 else -40.0, OFFENDS)
    times, sizes, word = (np.concatenate([np.zeros(0, np.int32), *(np.array(r[c], np.int32) for r in bags)]) for c in ("times", "sizes", "words"))
    doc_of = np.repeat(np.arange(n_docs, dtype=np.int32), [len(r.times) for r in bags])
    blank = np.array([r.n - sum(r.times) for r in bags], np.float64)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    v = len(vocabulary)
    theta = np.zeros(v + 1)
    theta[v] = np.log(y.mean()) - np.log(n / n_docs)
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    for k in range(1, rounds + 1):
        z = theta[v] + np.bincount(sentence, theta[word], len(sizes))
        total = np.maximum(np.bincount(doc_of, times * softplus(z), n_docs) + blank * softplus(theta[v]), 1e-9)
        to_total = np.where(y == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) / n_docs
        to_z = to_total[doc_of] * times * logistic(z)
        g = np.append(np.bincount(word, to_z[sentence], v), to_z.sum() + (to_total * blank).sum() * logistic(theta[v]))
        g[:v] += ridge * theta[:v]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate * min(1.0, 3 * (1 - k / (rounds + 1)))
        theta -= step * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Model(vocabulary, theta[:v], float(theta[v]), OFFENDS)


def doc_scores(model: Model, w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' scores, sentences' scores, the sentence of each word, the first sentence of each text."""
    sentence, first = sentences(w)
    z = model.logits(w, sentence, int(first[-1]))
    each, total = logistic(z), np.zeros(len(first) - 1)
    some = first[1:] > first[:-1]
    total[some] = softplus(np.maximum.reduceat(z, first[:-1][some])) if some.any() else 0.0
    counted = X.sums(np.where(each >= model.least, softplus(z), 0.0), first)
    return -np.expm1(-np.maximum(counted, total)), each, sentence, first


def held_out(doc_id: str) -> F.Column:
    """Whether a document's label must not be learned from; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def one_text_each(sample: DataFrame) -> DataFrame:
    """``y`` and ``text`` of each ``id`` once, however often it is repeated."""
    return sample.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = MOST_DOCS) -> Model:
    """A model from the labels that aren't held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = written(one_text_each(texts.join(F.broadcast(known), "id")), "toxicity-sample")
    n_docs, n_bad = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    vocabulary = screened(sample, n_docs, n_bad) if 0 < n_bad < n_docs else np.zeros(0, np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    bags = sample.mapInArrow(_bagger(sent), BAGS).collect()
    dropped(sample)
    sent.destroy()
    return fit(sorted(bags), vocabulary)


def _scorer(sent, column: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, offending = [], []
            for a, b, texts in X.slices(batch.column(batch.schema.names.index(column)), SLICE_BYTES):
                w = X.words(texts, X.LOWER_WORDS, lower=True)
                score, each, sentence, first = doc_scores(model, w)
                scores.append(score)
                found: list = [[] for _ in range(b - a)]
                for i in np.flatnonzero(score >= THRESHOLD):
                    bad = first[i] + np.flatnonzero(each[first[i] : first[i + 1]] >= least)
                    raw = w.data[texts.offs[i] : texts.offs[i + 1]]
                    chars = np.cumsum((raw & 0xC0) != 0x80)
                    lo, hi = np.searchsorted(sentence, bad), np.searchsorted(sentence, bad, side="right") - 1
                    for s, x, y in zip(bad, lo, hi, strict=True):
                        found[i].append({"start": int(chars[w.start[x] - texts.offs[i]]) - 1, "end": int(chars[w.end[y] - 1 - texts.offs[i]]), "score": float(each[s])})
                offending += found
            got = pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(offending, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))], names=["score", "offending"])
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    return X.lean(run)


def scored(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` and at the end the struct SCORED.

    ``offending`` locates, in code points from the first to the last word, the sentences of a score of ``least`` or
    more in documents that are predicted toxic.
    """
    names = docs.columns
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*fields, T.StructField(f"c{len(fields)}", SCORED)])
    return docs.toDF(*[f.name for f in fields]).mapInArrow(_scorer(sent, f"c{names.index(text_col)}", least), schema)


def harmless(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without those that are predicted toxic."""
    names = docs.columns
    rows = scored(docs, model, text_col)
    last = rows.columns[-1]
    return rows.where(F.col(f"{last}.score") < THRESHOLD).drop(last).toDF(*names)

"""Quality by a document classifier and hierarchical empirical Bayes over sites.

A logistic model of a text's make-up (shares of kinds of characters, lengths,
repetition) gives each document's evidence. All documents' evidence is summed by
host and by path. A host's posterior is its mean shrunk towards the corpus, a
path's its mean shrunk towards its host; how strongly is estimated from how much
hosts differ, and paths within hosts, by the method of moments. A document's
score combines its evidence with its path's posterior, from which its own share
is taken out first, so a site with few documents says little.

Sums are made in each task before the shuffle, so a host with a third of all rows
costs one row a task. Only the moments come to the driver. The classifier is
fitted on a bounded sample (``MOST_DOCS`` labelled documents, the first by a hash
of the id), of which only features come to the driver.

Web pages are judged by their URL's host and the first part of its path, and by
their text without mark-up (``page_sites``, ``page_text``).

Defined results: a null or empty text has features of zero; a very long text is
looked at whole, in some twelve bytes for each of its bytes; a null host or path is
one of its own; null labels, and labels that are held out or lack a document, are
not learned from; several labels of a document count by their mean, a half or more
as 1, and of its texts the one of the least hash is learned from; without two kinds
of labels the evidence is even; a score of exactly THRESHOLD is good; repeated
documents are rows of their own; an empty table gives no rows. Only the named
columns are looked at, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .store import written
from .toxicity import held_out, one_text_each

MOST_DOCS = 20_000
THRESHOLD = 0.5
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6

_KIND = np.zeros(256, np.int64)
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[0x80:] = 4
_KIND[[0x20, 0x09, 0x0D]] = 5
_KIND[0x0A] = 6
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
for _i, _c in enumerate(_MARKS):
    _KIND[ord(_c)] = 7 + _i
_N_KINDS = 7 + len(_MARKS)
_IN_KIND = np.zeros((256, _N_KINDS), np.int64)
_IN_KIND[np.arange(256), _KIND] = 1


def features(texts: X.Texts) -> np.ndarray:
    """A row for each text: square roots of the shares of character kinds, then lengths and repetition."""
    n, size = len(texts), np.diff(texts.offs)
    # a text's bytes are counted by themselves, which takes no more than they do
    counts = np.stack([np.bincount(texts.data[a:b], minlength=256) for a, b in zip(texts.offs.tolist(), texts.offs[1:].tolist(), strict=False)]) @ _IN_KIND
    w = X.words(texts, X.SPACED_WORDS)
    words, of = w.counts, w.owners()
    h = X.mix(X.hashes(w) ^ X.mix(of.astype(np.uint64) + np.uint64(1)))
    _, first, number = np.unique(h, return_index=True, return_counts=True)
    distinct, most = np.bincount(of[first], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, of[first], number)
    some = np.maximum(words, 1)
    return np.column_stack([np.sqrt(counts / np.maximum(size, 1)[:, None]), np.log1p(words), X.sums(w.end - w.start, w.first) / some, distinct / some, most / some, np.log1p(words / (counts[:, 6] + 1))])


@dataclass
class Model:
    """A logistic model of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """The model of greatest likelihood less a ridge penalty, by Newton's method."""
    k = x.shape[1] if len(x) else _N_KINDS + 5
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    theta, penalty = np.zeros(k + 1), np.append(np.full(k, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, theta[:k], float(theta[k]))


@X.lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in X.slices(batch.column(1)):
            rows = [r.tobytes() for r in features(texts).astype("<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], names=["y", "x"])


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = MOST_DOCS) -> Model:
    """A model from the labels that aren't held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = one_text_each(texts.join(F.broadcast(known), "id")).mapInArrow(_features, "y int, x binary").collect()
    rows.sort(key=lambda r: (bytes(r.x), r.y))
    x = np.array([np.frombuffer(r.x, "<f8") for r in rows]) if rows else np.zeros((0, _N_KINDS + 5))
    return fit(x, np.array([r.y for r in rows], np.float64))


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [model.logits(features(texts)) for _, _, texts in X.slices(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(got) if got else np.zeros(0))], names=["doc_id", "host", "path", "logit"])

    return X.lean(run)


def page_sites(url: Column) -> tuple[Column, Column]:
    """A URL's host, and the first part of its path (empty for none). A text that is no URL has neither."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]*)", 1)
    return F.when(host != "", host), F.when(host != "", path)


def page_text(html: Column) -> Column:
    """What stands outside of tags, comments, scripts and styles, with a space for each tag."""
    pieces = F.transform(F.split(F.coalesce(html, F.lit("")), "<", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def behind(p: Column) -> Column:
        hidden = p.x.rlike("^(?i:script|style)") | p.x.startswith("!--") & (F.instr(p.x, "-->") == 0)
        return F.when(p.i == 0, p.x).when(hidden, "").when(p.x.startswith("!--"), F.regexp_replace(p.x, "(?s)^!--.*?-->", "")).otherwise(F.regexp_replace(p.x, "^[^>]*>?", ""))

    return F.array_join(F.transform(pieces, behind), " ")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: str, prior: str) -> float:
    """How many documents a prior is worth, from groups of ``n`` documents with ``mean``, whose prior mean is ``prior``.

    What groups differ beyond chance is the variance of a Beta prior, which gives its strength.
    """
    spread = F.col(prior) * (1 - F.col(prior))
    got = groups.where("n > 1").agg(F.sum(F.col("n") * (F.col(mean) - F.col(prior)) ** 2).alias("between"), F.sum(F.col("within")).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * spread).alias("spread")).first()
    if not got.n:
        return MOST_STRENGTH
    variance = (got.between - got.chance) / got.n
    if variance <= 0:
        return MOST_STRENGTH
    return float(min(max(got.spread / got.n / variance - 1, LEAST_STRENGTH), MOST_STRENGTH))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Sums by path with those of their host, the corpus mean, and both strengths, from rows of host, path and ``p``."""
    keys = ["host", "path"]
    paths = evidence.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = total.s / total.n if total.n else 0.5
    # the variance of a group's mean by chance, times its size
    within = lambda n, s, q: (F.col(q) / F.col(n) - (F.col(s) / F.col(n)) ** 2) * F.col(n) / F.greatest(F.col(n) - 1, F.lit(1))
    by_host = hosts.select(F.col("host_n").alias("n"), (F.col("host_s") / F.col("host_n")).alias("mean"), F.lit(mean).alias("prior"), within("host_n", "host_s", "host_q").alias("within"))
    host_strength = strength(by_host, "mean", "prior")
    sites = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.host", "path", "n", "s", "q", "host_n", "host_s")
    host_mean = (F.col("host_s") + host_strength * mean) / (F.col("host_n") + host_strength)
    by_path = sites.select("n", (F.col("s") / F.col("n")).alias("mean"), host_mean.alias("prior"), within("n", "s", "q").alias("within"))
    path_strength = strength(by_path, "mean", "prior")
    return sites.select("host", "path", "n", "s", "host_n", "host_s"), mean, host_strength, path_strength


def scored(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``doc_id``, ``host``, ``path``, ``evidence`` (of the text alone), ``host_posterior`` and
    ``path_posterior`` (without the document itself), ``score`` and ``predicted`` (1: good)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = written(rows.mapInArrow(_scorer(sent), f"doc_id {kind}, host string, path string, logit double"), "evidence")
    rows = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least("logit", F.lit(30.0)), F.lit(-30.0)))))
    sites, mean, host_strength, path_strength = posteriors(rows)
    sites = sites.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    host_mean = (F.col("host_s") - F.col("p") + host_strength * mean) / (F.col("host_n") - 1 + host_strength)
    out = out.withColumn("host_posterior", host_mean)
    out = out.withColumn("path_posterior", (F.col("s") - F.col("p") + path_strength * F.col("host_posterior")) / (F.col("n") - 1 + path_strength))
    # the evidence already holds the corpus mean once, so the site counts by how it differs from that
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean)))))
    out = out.withColumn("score", F.round(score, 9))
    return out.select("doc_id", "host", "path", F.round("p", 9).alias("evidence"), F.round("host_posterior", 9).alias("host_posterior"), F.round("path_posterior", 9).alias("path_posterior"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

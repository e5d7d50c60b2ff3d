import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import site_quality as Q
from heddle.llm import textcore as X
from heddle.llm.queries import QUERIES


def corpus(n=900):
    random.seed(9)
    rows = []
    for i in range(n):
        good = random.random() < 0.7
        w = [random.choice("abcdefgh") * random.randrange(1, 8) for _ in range(random.randrange(20, 60))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), f"h{i % 5}", "p", int(good)))
    return rows


def test_classifier_on_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = Q.scored(docs, Q.trained(docs, labels), F.col("source"), F.col("lang")).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == rows[r.doc_id][4] for r in held]) > 0.97


def test_sparse_sites_stay_near_the_corpus(spark):
    """Texts that say little, on a good host, a bad one, and one of a single document."""
    random.seed(2)
    rows = [(i, "x", "good" if i < 300 else "bad", f"p{i % 3}") for i in range(600)] + [(600, "x", "lone", "p")]
    evidence = spark.createDataFrame([(h, p, min(0.99, max(0.01, random.gauss(0.9 if h != "bad" else 0.2, 0.1)))) for _, _, h, p in rows], "host string, path string, p double")
    sites, mean, host_strength, path_strength = Q.posteriors(evidence)
    assert 0.5 < mean < 0.6
    assert host_strength < 20 < path_strength
    got = {(r.host, r.path): (r.host_s + host_strength * mean) / (r.host_n + host_strength) for r in sites.collect()}
    assert got["good", "p0"] > 0.85 and got["bad", "p0"] < 0.25
    # a single document moves its host's posterior only part of the way
    assert mean < got["lone", "p"] < got["good", "p0"]


def test_a_documents_own_evidence_isnt_its_sites(spark):
    docs = spark.createDataFrame([(1, "words here", "a", "p"), (2, None, None, None), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = Q.scored(docs, Q.trained(docs, labels), F.col("source"), F.col("lang")).collect()
    assert len(out) == 3
    assert all(abs(r.score - 0.5) < 1e-6 and abs(r.path_posterior - 0.5) < 1e-6 for r in out)


def brute_strength(groups):
    """Of (values, prior mean)."""
    groups = [(np.array(v), prior) for v, prior in groups if len(v) > 1]
    n = sum(len(v) for v, _ in groups)
    if not n:
        return Q.MOST_STRENGTH
    between = sum(len(v) * (v.mean() - prior) ** 2 for v, prior in groups)
    variance = (between - sum(v.var(ddof=1) for v, _ in groups)) / n
    spread = sum(len(v) * prior * (1 - prior) for v, prior in groups) / n
    return min(max(spread / variance - 1, Q.LEAST_STRENGTH), Q.MOST_STRENGTH) if variance > 0 else Q.MOST_STRENGTH


def brute(model, rows):
    """Of (id, host, path, text): evidence, host and path posterior, and score, by the formulas alone."""
    p = {}
    for i, _, _, text in rows:
        ((_, _, part),) = X.slices(pa.array([text], pa.string()), 1 << 40)
        p[i] = 1 / (1 + math.exp(-min(max(float(model.logits(Q.features(part))[0]), -30), 30)))
    mean = sum(p.values()) / len(p)
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, host, path, _ in rows:
        hosts[host].append(p[i])
        paths[host, path].append(p[i])
    a = brute_strength([(v, mean) for v in hosts.values()])
    b = brute_strength([(v, (sum(hosts[h]) + a * mean) / (len(hosts[h]) + a)) for (h, _), v in paths.items()])
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = {}
    for i, host, path, _ in rows:
        h = (sum(hosts[host]) - p[i] + a * mean) / (len(hosts[host]) - 1 + a)
        s = (sum(paths[host, path]) - p[i] + b * h) / (len(paths[host, path]) - 1 + b)
        out[i] = (p[i], h, s, 1 / (1 + math.exp(-(logit(p[i]) + logit(s) - logit(mean)))))
    return out


def shown(html):
    head, *rest = (html or "").split("<")
    return " ".join([head, *("" if re.match("script|style", x, re.I) else x.partition("-->" if x.startswith("!--") else ">")[2] for x in rest)])


def test_query_same_as_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(("d", r.doc_id), f"source:{r.source}", r.lang, r.text) for r in docs.collect()]
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host, path = re.match(r"\w+://([^/?#:]+)(?:/([^/?#]*))?", r.url).groups()
        rows.append((("p", r.page_id), host.lower(), path or "", shown(r.html)))
    want = brute(Q.trained(docs, labels), rows)
    site = {x[0]: x[1:3] for x in rows}
    got = QUERIES["op1_quality"](spark, sf).collect()
    assert len(got) == len(rows) and len({x[1] for x in rows}) > 20
    for r in got:
        key = ("d", r.doc_id) if r.page_id is None else ("p", r.page_id)
        assert (r.host, r.path) == site[key]
        assert (r.evidence, r.host_posterior, r.path_posterior, r.score) == pytest.approx(want[key], abs=1e-7)
        assert r.kept == (r.predicted == 1) == (r.score >= Q.THRESHOLD)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1 if r.page_id is None else None)


def test_sites_and_texts_of_pages(spark):
    urls = ["https://Www.a-b.example.com/en/1?x=/y", "http://u:p@h:80", "http://h?q=/a/b", "http://h//x#y", "no url", "", None, "ftp://h/"]
    host, path = Q.page_sites(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host, path).collect()]
    assert got == [("www.a-b.example.com", "en"), ("h", ""), ("h", ""), ("h", "x"), (None, None), (None, None), (None, None), ("h", "")]
    html = ["a<p>b</p>c<br", "<script>x<y</script>z", "<STYLE>a{}</STYLE>b<!-- c -->d", "plain > text", "", None, "<" * 200_000]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in html], "h string").select(Q.page_text(F.col("h"))).collect()]
    assert got[:6] == ["a b c ", "   z", "  b d", "plain > text", "", ""] and got[6].strip() == ""
    assert [shown(h) for h in html[:6]] == got[:6]


def test_repeated_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(0, "b b"), *[(0, "a a")] * 50, (2, "C!")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    once = spark.createDataFrame([(0, min(("a a", "b b"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])), (2, "C!")], "doc_id long, text string")
    a, b = Q.trained(docs, labels), Q.trained(once, labels)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias

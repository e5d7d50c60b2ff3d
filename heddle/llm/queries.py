"""The operators over the whole of their tables, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials as _credentials
from . import decontaminate as _decontaminate
from . import licenses as _licenses
from . import line_rules as _line_rules
from . import near_dups as _near_dups
from . import packing as _packing
from . import sharding as _sharding
from . import site_quality as _site_quality
from . import substrings as _substrings
from . import toxicity as _toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents and web pages by their text and their site.

    A page has its URL's host, and the first part of its path. A document has no URL: its source is its host, and its
    language its path in it. Labels are of documents alone, and pages are scored by the same model. A document's row has
    a ``doc_id``, a page's a ``page_id``.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = _site_quality.trained(docs, _table(spark, sf_dir, "labels"))
    host, path = _site_quality.page_sites(F.col("url"))
    whole = docs.select(F.struct("doc_id", F.lit(None).cast("long").alias("page_id")).alias("id"), F.concat(F.lit("source:"), "source").alias("host"), F.col("lang").alias("path"), "text")
    whole = whole.union(pages.select(F.struct(F.lit(None).cast("long").alias("doc_id"), "page_id"), host, path, _site_quality.page_text(F.col("html"))))
    rows = _site_quality.scored(whole, model, F.col("host"), F.col("path"), "id").withColumnsRenamed({"doc_id": "id"})
    columns = ["id.doc_id", "id.page_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "predicted"]
    return rows.select(*columns, F.when(F.col("id.page_id").isNull(), _toxicity.held_out("id.doc_id")).alias("held_out"), (F.col("predicted") == 1).alias("kept"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark passages in each document, and its longest verbatim match, by suffix arrays."""
    found = _decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), "contaminated", "longest_words", "longest_item", "longest_start")


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and numbers of links of documents that share four fifths of their five-grams."""
    return _near_dups.joined(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, by pattern and by who else holds them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows, found = _credentials.scanned(docs, repository=F.struct("source", "lang"), keep_text=False)
    spans = F.col(f"{found}.spans")
    base = F.filter(spans, lambda s: s.kind < _credentials.BASE)

    def count(kind: int) -> F.Column:
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{_credentials.KINDS[kind]}")

    live = F.size(F.filter(spans, lambda s: ~F.array_contains(F.col(f"{found}.examples"), s.h))).cast("long")
    return rows.select("doc_id", *[count(kind) for kind in range(_credentials.BASE)], F.sha2(_credentials.listed(base).cast("binary"), 256).alias("base_sha256"), _credentials.listed(spans).alias("spans"), live.alias("n_live"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or scores of all documents, by a model of sentences learned from two thirds of the labels, and the places of
    the offending sentences in toxic documents, as start:end in code points."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _toxicity.scored(docs, _toxicity.trained(docs, _table(spark, sf_dir, "labels"))).toDF("doc_id", "text", "got")
    places = F.array_join(F.transform("got.offending", lambda x: F.concat_ws(":", x.start, x.end)), ",").alias("offending")
    return rows.select("doc_id", _toxicity.held_out("doc_id").alias("held_out"), "got.score", (F.col("got.score") >= _toxicity.THRESHOLD).cast("int").alias("predicted"), places)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    return _sharding.law(_sharding.placed(_table(spark, sf_dir, "documents")))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on each text, and on lines that many documents of a source hold."""
    rows, name = _line_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return rows.select("doc_id", *[f"{name}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")], F.array_join(f"{name}.removed", ",").alias("removed_lines"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in each document."""
    rows = _licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).toDF("doc_id", "text", "got")
    return rows.select("doc_id", *[f"got.{c}" for c in ("n_words", "n_base", "first_word", "last_word")], *[F.array_join(f"got.{c}", ",").alias(c) for c in ("base_labels", "labels")], "got.score")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that documents of lesser ids hold."""
    return _substrings.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids in sequences of at most 4,096."""
    import public_tokenizers

    pieces = _packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_dups": op3_near_dups,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_line_rules": op7_line_rules,
    "op8_licenses": op8_licenses,
    "op9_substrings": op9_substrings,
    "op10_packing": op10_packing,
}

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _template_pattern(template: str) -> str:
    """A template as a regular expression over words that each have a space before them, and one after the last."""

    def wording(text: str) -> str:
        return "".join(f" {w.decode()}" for w in _licenses.tokens(text))

    out = ""
    for text, optional, most in re.findall(r"((?:(?!\[\[|\{\{).)+)|\[\[(.*?)\]\]|\{\{(\d+)\}\}", template, re.S):
        out += wording(text) if text else f"(?:{_template_pattern(optional)[:-1]})?" if optional else f"(?: [^ ]+){{1,{most}}}"
    return out + " "


def _secret_sql() -> str:
    c = _credentials
    assign = c.ASSIGN.replace("'", "''")
    sets = ((assign, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32), ("[A-Za-z0-9_]+", 0, 24))
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, {kind} AS kind, {least} AS least, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {g}) AS s, string_split_regex(text, '{p}') AS p FROM d"
        for kind, (p, g, least) in enumerate(sets)
    )
    name = f"(['{"', '".join(c.KINDS)}'])[kind + 1]"
    return rf"""
        WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
        m AS ({found}),
        u AS (SELECT *, unnest(list_filter(range(1, len(m) + 1), lambda i: length(s[i]) >= least)) AS i FROM m),
        x AS (SELECT doc_id, source, lang, kind, s[i] AS s, length(m[i]) AS n,
                     list_sum(list_transform(p[1 : i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: length(z))), 0) AS a FROM u),
        g AS (SELECT *, a + n AS b FROM x WHERE kind < 3 OR (regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]'))),
        e AS (SELECT s FROM g GROUP BY s HAVING count(DISTINCT source) >= {c.EXAMPLE_OWNERS} OR count(DISTINCT (source, lang)) FILTER (source IS NOT NULL) >= {c.EXAMPLE_REPOSITORIES}),
        k AS (SELECT g.*, e.s IS NOT NULL AS copied, {name} || ':' || a || ':' || b AS span FROM g LEFT JOIN e USING (s) WHERE kind < 3 OR e.s IS NULL),
        r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (NOT copied) AS n_live,
                     string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY a, kind) AS spans FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
        FROM d LEFT JOIN r USING (doc_id)"""


def _license_sql() -> str:
    places = " UNION ALL ".join(f"SELECT {i} AS p, '{phrase}' AS phrase, '{label}' AS label" for i, (phrase, label) in enumerate(_licenses.PHRASES.items()))
    full = ", ".join(f"CASE WHEN regexp_matches(t, '{_template_pattern(t)}') THEN '{label}' END" for label, t in _licenses.TEMPLATES)
    return rf"""
        WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        e AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
        f AS (SELECT doc_id, w, list_filter([{full}], lambda x: x IS NOT NULL) AS whole FROM e),
        p AS ({places}),
        k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d WHERE len(w) > 0),
        b AS (SELECT doc_id, k - 1 AS k, label FROM k JOIN p ON array_to_string(w[k : k + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
        g AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS z, list(DISTINCT label) AS plain FROM b GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word,
               CAST(z AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(plain, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(plain, []), whole))), ',') AS labels,
               CAST(CASE WHEN len(whole) > 0 THEN 1 WHEN n > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
        FROM f LEFT JOIN g USING (doc_id)"""


ORACLE: dict[str, str] = {
    "op2_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
        iw AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
        pos AS (SELECT item_id, n, k AS p, array_to_string(w[k : k + n - 1], ' ') AS t FROM iw),
        win AS (SELECT DISTINCT item_id, n, t FROM pos),
        sizes AS (SELECT DISTINCT n FROM win),
        dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
        dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS t FROM dk),
        hit AS (SELECT dw.doc_id, dw.n, dw.k, win.item_id, dw.t FROM dw JOIN win USING (n, t)),
        hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS j FROM hit) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
        pairs AS (SELECT DISTINCT doc_id, item_id, n, k, k - p AS along FROM hit JOIN pos USING (item_id, n, t)),
        runs AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, n, along ORDER BY k) AS run FROM pairs),
        whole AS (SELECT doc_id, item_id, min(k) - 1 AS start, n + count(*) - 1 AS words FROM runs GROUP BY doc_id, item_id, n, along, run),
        longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item_id NULLS FIRST, start) AS r FROM whole) WHERE r = 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
               CAST(coalesce(words, 0) AS BIGINT) AS longest_words, CAST(longest.item_id AS VARCHAR) AS longest_item, CAST(start AS BIGINT) AS longest_start
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op8_licenses": _license_sql(),
    "op7_line_rules": rf"""
        WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'none' ELSE '=' || source END AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, string_split(text, chr(10)) AS every FROM d),
        k AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS k, w FROM w WHERE len(w) >= 8),
        g AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS g FROM k),
        r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 8)) AS j FROM r) GROUP BY doc_id),
        ll AS (SELECT doc_id, source, unnest(list_transform(every, lambda x: regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+'))) AS x, unnest(range(len(every))) AS i FROM w),
        ln AS (SELECT doc_id, source, array_to_string(x, ' ') AS line, len(x) AS n, i FROM ll WHERE len(x) > 0),
        h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
        bad AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM ln GROUP BY source, line) JOIN h USING (source)
                WHERE n > {_line_rules.LEAST_DOCS} AND n > {_line_rules.LEAST_SHARE} * docs),
        lost AS (SELECT doc_id, sum(n) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines FROM ln JOIN bad USING (source, line) GROUP BY doc_id),
        m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                     CAST(coalesce(lost.n, 0) AS BIGINT) AS n_frequent_words, coalesce(lost.lines, '') AS removed_lines
              FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
        f AS (SELECT *, n_words < {_line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * _line_rules.MOST_REPEATED)} * n_words AS base_failed FROM m)
        SELECT *, NOT base_failed AND n_frequent_words <= {_line_rules.DEPLETED} * n_words AS kept FROM f""",
    "op4_secrets": _secret_sql(),
    "op3_near_dups": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM k),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        groups AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
        counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
        SELECT d.doc_id, least(d.doc_id, coalesce(least, d.doc_id)) AS class_id, coalesce(n, 0) AS n_links
        FROM d LEFT JOIN groups USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op9_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        k AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS k, w FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM k),
        least AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS j FROM g JOIN least USING (g) WHERE least < doc_id),
        n AS (SELECT doc_id, list(j) AS j FROM gone GROUP BY doc_id),
        e AS (SELECT d.doc_id, w, coalesce(j, []) AS j FROM d LEFT JOIN n USING (doc_id)),
        u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.j = u.i WHERE gone.j IS NULL GROUP BY u.doc_id)
        SELECT e.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(j) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM e LEFT JOIN kept USING (doc_id)""",
}

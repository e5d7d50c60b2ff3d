"""Quality rules with the frequency of lines across documents, with DataFrame operations only.

Lines are normalised (white space runs become one space, letters lower case) and
hashed. For each host, the documents that hold a line are counted once each;
lines held by more than a limit are boilerplate. Documents lose those lines, and
one that loses more than ``DEPLETED`` of its words is rejected, besides those
that fail rules on their own text.

A line counts once for each document of a host, documents being told apart by id:
distinct (host, line, id) first, then summed in each task, so that a line of a third
of all documents costs one row a task; the few lines above the limit are a table of
their own, joined back by a join that can split hot lines.

Defined results: a null or wordless text has no words and lines; a very long text
is measured whole, in one row's memory, some forty bytes for each of its words; a
null host is a host of its own; rows repeated with their id are one document's when
lines are counted, and have a result each; a null id is no document's, so its lines
don't count but are judged; of lines alike in one text all are removed, and a line
held by exactly the limit stays; an empty table gives no rows. Own columns are kept
in a struct whose name no column of the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import columns_of, written

#: A line is boilerplate in a host if more documents hold it than both.
LEAST_DOCS, LEAST_SHARE = 20, 0.01
DEPLETED = 0.5
#: Rules on a document alone.
LEAST_WORDS, MOST_REPEATED = 20, 0.30
REPEAT_WINDOW = 8

_SPACE = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE, -1))


def _paired(hashes: Column, apart: int) -> Column:
    return F.zip_with(hashes, F.slice(hashes, apart + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, text_col: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with the struct ``name``: the measures of each text, and its lines with words: number from 0, hash, and number of words."""
    # columns of their own, each used twice or more by the next step: Spark then computes each once
    c = {k: f"{name}_{k}" for k in ("t", "w", "l", "n", "lines", "h1", "h2", "h4", "h8", "s", "p")}
    col = {k: F.col(v) for k, v in c.items()}
    norm = _SPACE, " "
    step = docs.withColumn(c["t"], F.coalesce(F.col(text_col), F.lit("")))
    step = step.withColumns({c["w"]: _words(col["t"]), c["l"]: F.filter(F.transform(F.split(col["t"], "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z.x.rlike(_WORD))})
    step = step.withColumns(
        {
            c["n"]: F.size(col["w"]),
            c["h1"]: F.transform(col["w"], lambda w: F.xxhash64(w)),
            c["lines"]: F.transform(F.transform(col["l"], lambda z: F.struct(z.i.alias("i"), F.lower(F.regexp_replace(F.btrim(z.x, F.lit(_BLANK)), *norm)).alias("x"))), lambda z: F.struct(z.i.alias("i"), F.xxhash64(z.x).alias("h"), F.size(F.split(z.x, " ", -1)).alias("n"))),
        }
    )
    for old, new, apart in (("h1", "h2", 1), ("h2", "h4", 2), ("h4", "h8", 4)):
        step = step.withColumn(c[new], _paired(col[old], apart))
    # the hashes of the last seven places lack words
    step = step.withColumn(c["h8"], F.when(col["n"] >= REPEAT_WINDOW, F.slice(col["h8"], F.lit(1), F.greatest(col["n"] - (REPEAT_WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn(c["s"], F.when(F.size(F.array_distinct(col["h8"])) < F.size(col["h8"]), F.sort_array(F.transform(col["h8"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    # a window is a repeat if its neighbour before or after in the order has its hash
    pairs = F.filter(F.zip_with(F.concat(none, col["s"]), F.concat(col["s"], none), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: z.x.h == z.y.h)
    step = step.withColumn(c["p"], F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z.x.i, z.y.i))))))
    # each repeat covers as many more words as come before the next one, eight at most
    covered = F.aggregate(F.zip_with(col["p"], F.slice(col["p"], 2, F.greatest(F.size(col["p"]), F.lit(1))), lambda x, y: F.least(F.lit(REPEAT_WINDOW), y - x)), F.lit(0).cast("long"), lambda total, x: total + x)
    t, lines = col["t"], F.transform(col["l"], lambda z: z.x)
    found = F.struct(
        col["n"].cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(col["l"]) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        col["lines"].alias("lines"),
    )
    return step.select(*columns_of(docs), found.alias(name))


def base_failed(name: str = "found") -> Column:
    return (F.col(f"{name}.n_words") < LEAST_WORDS) | (F.col(f"{name}.n_repeat_words") * 100 > F.col(f"{name}.n_words") * int(100 * MOST_REPEATED))


def frequent_lines(rows: DataFrame, host_col: str, id_col: str, name: str = "found", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host`` and ``h`` of the lines above the limit, from measured documents."""
    keys = ["host", "no_host"]
    known = rows.where(F.col(id_col).isNotNull()).select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(host_col).isNull().alias("no_host"), F.col(id_col).alias("id"), F.col(f"{name}.lines.h").alias("all"))
    docs = known.select(*keys, "id").distinct().groupBy(*keys).agg(F.count("*").alias("docs"))
    held = known.select(*keys, "id", F.explode(F.array_distinct("all")).alias("h")).distinct()
    counts = held.groupBy(*keys, "h").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    return counts.join(docs, keys).where(F.col("n") > least_share * F.col("docs")).select(*keys, "h")


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep_text: bool = True, name: str = "found", **limits) -> tuple[DataFrame, str]:
    """``docs`` with the measures, ``frequent`` (hashes of the document's lines above the limit), ``removed`` (these lines'
    numbers among all of the text, from 0), ``n_frequent_words``, ``base_failed`` and ``kept`` in a struct, and that struct's name. ``keep_text=False`` leaves the text column out."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    row = f"{name}_row"
    found = measured(docs, text_col, name)
    rows = written((found if keep_text else found.drop(text_col)).withColumn(row, F.monotonically_increasing_id()), "line-rules")
    bad = written(frequent_lines(rows, host_col, id_col, name, **limits), "frequent-lines")
    held = rows.select(F.col(row), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(host_col).isNull().alias("no_host"), F.explode(f"{name}.lines").alias("line"))
    lost = held.select(row, "host", "no_host", F.col("line.h").alias("h"), F.col("line.n").alias("n"), F.col("line.i").alias("i")).join(bad, ["host", "no_host", "h"]).groupBy(row).agg(F.sum("n").alias("n"), F.collect_set("h").alias("h"), F.sort_array(F.collect_list("i")).alias("i"))
    lost = lost.select(F.col(row), F.struct("n", "h", "i").alias(f"{name}_lost"))
    out = rows.join(lost, row, "left")
    gone = F.coalesce(F.col(f"{name}_lost.n"), F.lit(0)).cast("long")
    failed = base_failed(name)
    out = out.withColumn(
        name,
        F.col(name)
        .withField("frequent", F.coalesce(F.col(f"{name}_lost.h"), F.array().cast("array<bigint>")))
        .withField("removed", F.coalesce(F.col(f"{name}_lost.i"), F.array().cast("array<int>")))
        .withField("n_frequent_words", gone)
        .withField("base_failed", failed)
        .withField("kept", ~failed & (gone <= DEPLETED * F.col(f"{name}.n_words"))),
    )
    return out.drop(row, f"{name}_lost"), name


def cleaned(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The kept rows of ``docs``, their texts without the lines above the limit."""
    rows, name = judged(docs, host_col, text_col, **limits)
    norm = lambda x: F.xxhash64(F.lower(F.regexp_replace(F.btrim(x, F.lit(_BLANK)), _SPACE, " ")))
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~(x.rlike(_WORD) & F.array_contains(F.col(f"{name}.frequent"), norm(x)))), "\n")
    rows = rows.where(F.col(f"{name}.kept"))
    return rows.withColumn(text_col, F.when(F.size(f"{name}.frequent") > 0, left).otherwise(F.col(text_col))).select(*columns_of(docs))

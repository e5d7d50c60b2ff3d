"""Secret scans with ownership frequency across the corpus, with DataFrame operations only.

Patterns find candidates in each whole text. Their hashes are aggregated over
the corpus by distinct owners and repositories: a value that many owners hold is
an example that was copied around, one that a single owner holds looks live.
Spans of the base kinds are reported either way; long mixed tokens without a
telling name count as secrets only if they look live.

Aggregation is by (hash, owner, repository) first, summed in each task, so that
a value in a third of all rows costs one row a task. Only values found to be
examples are joined back, by a join that can split hot values.

Spans are in code points, the end exclusive. A span is a struct of ``start``,
``kind`` (its number in KINDS), ``end`` and ``h``, the hash of its secret. Places
are sums of lengths, made in blocks of matches (``BLOCK``), and texts are masked in
pieces (``PIECE``), so that neither copies what it has for each match.

Defined results: a null or empty text has no spans; very long texts, and texts of
very many matches, are scanned whole, in one row's memory; rows of a null owner
have spans, but tell of no owner and no repository; a null repository is one of
its owner's; of matches at one place each kind has its own; repeated documents
are rows of their own, with the same owner; an empty table gives no rows. Own
columns have names that no column of the input has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import columns_of, written

#: Kinds in order; the first three are the base.
KINDS = ("assign", "access", "hex", "token")
BASE = 3
#: A value with so many owners, or so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs that are too short are left out here, as a shorter run holds no match that is long enough
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}"
MASK = "[SECRET]"

#: Matches that are summed at once, and characters of a piece of a text that is masked.
BLOCK, PIECE = 256, 1 << 15

_CUTS = "array<struct<a:int,b:int,mask:boolean>>"
SPANS = "array<struct<start:int,kind:int,end:int,h:bigint>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _folded(items: Column, zero: Column, state: str, step: Callable, emit: Callable, out: str) -> Column:
    """What ``emit(before, x)`` yields for each item, flattened, where ``before`` is ``zero`` after a ``step`` for each item before.

    Items are taken in blocks, first for the state at the start of each, so that what grows is copied once a block.
    """

    def blocked(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest((F.ceil(F.size(xs) / BLOCK) - 1).cast("int"), F.lit(0))), lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))

    def both(blocks: Column) -> Column:
        begin = F.struct(zero.cast(state).alias("now"), F.array().cast(f"array<{state}>").alias("all"))
        starts = F.aggregate(blocks, begin, lambda acc, xs: F.struct(F.aggregate(xs, acc.now, lambda now, x: step(now, x).cast(state)).alias("now"), F.concat(acc.all, F.array(acc.now)).alias("all")), lambda acc: acc.all)

        def one(xs: Column, first: Column) -> Column:
            begin = F.struct(first.alias("now"), F.array().cast(out).alias("out"))
            return F.aggregate(xs, begin, lambda acc, x: F.struct(step(acc.now, x).cast(state).alias("now"), F.concat(acc.out, emit(acc.now, x)).alias("out")), lambda acc: acc.out)

        return F.flatten(F.zip_with(blocks, starts, one))

    return _let(_let(items, blocked), both)


def _located(text: Column, pattern: str, kind: int, group: int, least: int, good: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches, found by the lengths of the matches and of the pieces between them, whose group is long enough and ``good``."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.zip_with(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))), secrets, lambda a, s: F.struct(a.p.alias("p"), a.m.alias("m"), s.alias("s")))

    def emit(at: Column, x: Column) -> Column:
        begin = at + x.p
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x.m).alias("end"), F.xxhash64(x.s).alias("h"))
        counts = x.m.isNotNull() & (F.length(x.s) >= least)
        counts = counts & good(x.s) if good else counts
        return F.when(counts, F.array(span).cast(SPANS)).otherwise(F.array().cast(SPANS))

    return _folded(parts, F.lit(0), "int", lambda at, x: at + x.p + F.coalesce(x.m, F.lit(0)), emit, SPANS)


def candidates(text: Column) -> Column:
    """Spans of all kinds, those of the base by start and kind, in one array. A text without a kind is not split."""
    none = F.array().cast(SPANS)
    assign = F.when(text.rlike(ASSIGN), _located(text, ASSIGN, 0, 2, 8)).otherwise(none)
    access = F.when(text.rlike(ACCESS), _located(text, ACCESS, 1, 0, 16)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _located(text, HEX, 2, 0, 32)).otherwise(none)
    token = F.when(text.rlike(TOKEN), _tokens(text)).otherwise(none)
    return F.concat(assign, access, hexes, token)


def _tokens(text: Column) -> Column:
    """Long tokens that have a digit, a capital and a small letter."""
    mixed = F.exists(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _is_mixed)
    return F.when(mixed, _located(text, TOKEN, 3, 0, 24, _is_mixed)).otherwise(F.array().cast(SPANS))


def _is_mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def examples(spans: DataFrame, spans_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """Hashes ``h`` of the values that many owners or repositories hold."""
    held = spans.where(F.col(owner_col).isNotNull()).select(F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"), F.explode(F.array_distinct(F.col(f"{spans_col}.h"))).alias("h"))
    held = held.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = held.groupBy("h", "owner").agg(F.count("one").alias("repositories")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return owners.where((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)).select("h")


def _free(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def scanned(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None, keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct, and the struct's name: ``spans``, all that count, by start and kind, and ``examples``, the
    hashes among them of widely copied values. ``keep_text=False`` leaves the text column out."""
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    found, row, own, repo = (_free(x, docs) for x in ("found", "found_row", "found_owner", "found_repository"))
    text = _free("found_text", docs)
    rows = docs.withColumns({own: owner, repo: repository, text: F.coalesce(F.col(text_col), F.lit(""))})
    rows = rows.withColumn(found, candidates(F.col(text))).drop(text, *([] if keep_text else [text_col])).withColumn(row, F.monotonically_increasing_id())
    rows = written(rows, "secrets")
    copied = written(examples(rows, found, own, repo), "examples")
    held = rows.select(row, F.explode(F.array_distinct(F.col(f"{found}.h"))).alias("h"))
    held = held.join(copied, "h").groupBy(row).agg(F.collect_set("h").alias(f"{found}_copied"))
    out = rows.join(held, row, "left").withColumn(f"{found}_copied", F.coalesce(F.col(f"{found}_copied"), F.array().cast("array<bigint>")))
    counted = F.filter(found, lambda s: (s.kind < BASE) | ~F.array_contains(F.col(f"{found}_copied"), s.h))
    return out.withColumn(found, F.struct(F.array_sort(counted).alias("spans"), F.col(f"{found}_copied").alias("examples"))).drop(row, own, repo, f"{found}_copied"), found


def redacted(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` with MASK in place of all secrets but widely copied examples."""
    rows, found = scanned(docs, text_col, **how)
    live = F.filter(f"{found}.spans", lambda s: ~F.array_contains(F.col(f"{found}.examples"), s.h))
    text = F.col(text_col)
    none = F.array().cast(_CUTS)
    # what stays before each mask; a span that begins in the ones before only makes their mask longer
    cuts = _folded(live, F.lit(0), "int", lambda at, s: F.greatest(at, s.end), lambda at, s: F.when(s.start >= at, F.array(F.struct(at.alias("a"), s.start.alias("b"), F.lit(True).alias("mask"))).cast(_CUTS)).otherwise(none), _CUTS)
    rest = F.struct(F.array_max(F.transform(live, lambda s: s.end)).alias("a"), F.length(text).alias("b"), F.lit(False).alias("mask"))
    masked = _let(F.concat(cuts, F.array(rest).cast(_CUTS)), lambda all_: _pieced(text, all_))
    return rows.withColumn(text_col, F.when(F.size(live) > 0, masked).otherwise(text)).select(*columns_of(docs))


def _pieced(text: Column, cuts: Column) -> Column:
    """The parts of a text that ``cuts`` keep, each with MASK behind it if it says so. A part is looked for in a short piece of the text."""

    def piece(k: Column) -> Column:
        lo, hi = k * PIECE, (k + 1) * PIECE

        def part(here: Column) -> Callable[[Column], Column]:
            def of(c: Column) -> Column:
                a = F.greatest(c.a, lo)
                return F.concat(F.substring(here, a - lo + 1, F.greatest(F.least(c.b, hi) - a, F.lit(0))), F.when(c.mask & (c.b >= lo) & (c.b < hi), F.lit(MASK)).otherwise(F.lit("")))

            return of

        own = F.filter(cuts, lambda c: (c.a < hi) & (c.b >= lo))
        return _let(F.substring(text, lo + 1, PIECE), lambda here: F.array_join(F.transform(own, part(here)), ""))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), piece), "")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")

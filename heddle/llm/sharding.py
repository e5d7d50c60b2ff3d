"""Sharding by sampled splitters, with DataFrame operations only.

Records are keyed by a hash of their text, so that equal texts are neighbours,
then by id. A sample of keys, drawn with a chance in proportion to a record's
size, gives the splitters between many small ranges of about equal size. A range
that turns out overfull, as one with a much copied text, is subdivided by
splitters of a second sample that also look at the id and the row. Exact sizes of
the ranges, and sums within them, then give every record its place in the whole
order, which is cut into shards of equal bytes.

No task sorts more than a range. To the driver come a sample and the ranges'
splitters, both bounded by ``MOST_RANGES``. Splitters are tables that are broadcast
and joined by the first bits of a key, or by range; so is a table of the ranges.
Texts are read once, and only keys and sizes are shuffled.

Law ``bytes``: a shard's ends are off by no more than half a record or half a kept group. A
group of equal texts stays in one shard unless it is larger than ``TOLERANCE`` of
a shard; larger groups are cut where a shard is full.

Defined results: a null text has the size 1 and the checksum of an empty text; a
very long text is a record like others, and is never copied; a null id comes before
others; texts alike go by id, then by row; repeated documents take a place each; an
empty table gives no rows; only the two named columns are looked at, so no other
can clash.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import dropped, written

LEAST_RANGES, MOST_RANGES, RANGE_BYTES = 256, 8192, 64 << 20
#: Records sampled for each range.
PER_RANGE = 16
TOLERANCE = 0.005
#: Bits of a key by which its splitters are looked up, and of the number of splitters in one place.
FIRST_BITS, BITS = 12, 14


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def _count_up_to(array: Column, value: Column) -> Column:
    """How many of an array's ascending values are ``value`` or less, by halving."""
    steps = F.transform(F.sequence(F.lit(BITS), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    n = F.size(array)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.when(at + step <= n, F.get(array, at + step - 1) <= value).otherwise(False), at + step).otherwise(at))


def _by_key(spark: SparkSession, splitters: list[int]) -> DataFrame:
    """A row for each value of a key's first bits: ``first``, ``before`` (the splitters of lesser ones) and ``inside``."""
    rows, at = [], 0
    for first in range(-(1 << (FIRST_BITS - 1)), 1 << (FIRST_BITS - 1)):
        to = bisect.bisect_left(splitters, (first + 1) << (64 - FIRST_BITS))
        rows.append((first, at, splitters[at:to]))
        at = to
    return spark.createDataFrame(rows, "first long, before int, inside array<bigint>")


def _first(key: Column) -> Column:
    return F.call_function("shiftright", key, F.lit(64 - FIRST_BITS))


def _sampled(rows: DataFrame, rate: Column) -> DataFrame:
    """Records with a chance of ``size * rate``, each with the size it stands for."""
    chance = F.pmod(F.xxhash64(F.col("row"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(chance < F.col("size") * rate).withColumn("weight", F.greatest(F.col("size").cast("double"), 1 / rate))


def _quantiles(sample: list[tuple], parts: int) -> list:
    """Keys of a sorted sample of (key, weight) that cut it into parts of equal weight."""
    total, out, run = sum(w for _, w in sample), [], 0.0
    for key, weight in sample:
        if len(out) + 1 < parts and run >= total * (len(out) + 1) / parts:
            if not out or out[-1] != key:
                out.append(key)
            while len(out) + 1 < parts and run >= total * (len(out) + 1) / parts:
                total, parts = total - total / parts, parts - 1
        run += weight
    return out


def _ranged(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``part`` and ``sub``, whose order is that of key, id and row."""
    ranges = min(max(LEAST_RANGES, total // RANGE_BYTES), MOST_RANGES)
    fill = total / ranges
    sample = sorted((r.key, r.weight) for r in _sampled(rows, F.lit(PER_RANGE / fill)).select("key", "weight").collect())
    near = _by_key(rows.sparkSession, sorted(set(_quantiles(sample, ranges))))
    rows = rows.withColumn("first", _first(F.col("key"))).join(F.broadcast(near), "first")
    rows = written(rows.withColumn("part", F.col("before") + _count_up_to(F.col("inside"), F.col("key"))).drop("first", "before", "inside"), "sharding-parts")
    sizes = {r.part: r.bytes for r in rows.groupBy("part").agg(F.sum("size").alias("bytes")).collect()}
    overfull = {p: b for p, b in sizes.items() if b > 2 * fill}
    if not overfull:
        return rows.withColumn("sub", F.lit(0))
    full = F.broadcast(rows.sparkSession.createDataFrame([(p,) for p in overfull], "part int"))
    inside = rows.join(full, "part")
    more: dict[int, list] = {}
    for r in _sampled(inside, F.lit(PER_RANGE / fill)).select("part", "key", "doc_id", "row", "weight").collect():
        more.setdefault(r.part, []).append((r.key, r.doc_id, r.row, r.weight))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cuts = []
    for part, found in sorted(more.items()):
        found.sort(key=lambda x: (x[0], x[1] is not None, x[1] if x[1] is not None else 0, x[2]))
        order = {x[:3]: i for i, x in enumerate(found)}
        chosen = [found[i] for i in _quantiles([(order[x[:3]], x[3]) for x in found], max(1, round(overfull[part] / fill)))]
        keys = [x[0] for x in chosen]
        own = []
        for key, doc_id, row, _ in chosen:
            alone = bisect.bisect_right(keys, key) - bisect.bisect_left(keys, key) == 1
            own.append((key, None if alone else doc_id, -1 if alone else row))
        cuts.append((part, own))
    more_cuts = rows.sparkSession.createDataFrame(cuts, f"part int, cuts array<struct<key:bigint,doc_id:{kind},row:bigint>>")
    sub = F.coalesce(_count_up_to(F.col("cuts"), F.struct("key", "doc_id", "row")), F.lit(0))
    return rows.join(F.broadcast(more_cuts), "part", "left").withColumn("sub", F.when(F.col("cuts").isNull(), 0).otherwise(sub)).drop("cuts")


def placed(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each record's ``doc_id``, ``size``, ``text_crc32``, ``key``, ``shard`` and ``slot``, the place in the shard."""
    rows = written(_keyed(docs, id_col, text_col), "sharding-keys")
    total = rows.agg(F.sum("size").alias("n")).first().n or 0
    ranged = written(_ranged(rows, total) if total else rows.withColumns({"part": F.lit(0), "sub": F.lit(0)}), "sharding-ranges")
    dropped(rows)
    order = Window.orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range, so a window over all of them is small, and so is what is broadcast
    ranges = ranged.groupBy("part", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ranges = ranges.select("part", "sub", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("part", "sub").orderBy("key", "doc_id", "row")
    group = Window.partitionBy("part", "sub", "key", "text_crc32")
    ranges = written(ranges.withColumn("cut", F.max("sub").over(Window.partitionBy("part")) > 0), "sharding-sums")
    at = ranged.join(F.broadcast(ranges), ["part", "sub"])
    at = at.withColumns({"before": F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "place": F.col("rows_before") + F.row_number().over(own) - 1})
    at = places = written(at.withColumns({"group_start": F.min("before").over(group), "group_bytes": F.sum("size").over(group)}).drop("bytes_before", "rows_before"), "sharding-places")
    # groups in more than one range of a subdivided part are at most as many as its ranges
    names = {"part": "p", "key": "k", "text_crc32": "c"}
    wide = at.where("cut").groupBy(*names).agg(F.min("before").alias("wide_start"), F.sum("size").alias("wide_bytes"), F.min("sub").alias("lo"), F.max("sub").alias("hi")).where("lo < hi").drop("lo", "hi").withColumnsRenamed(names)
    at = at.join(F.broadcast(wide), (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")) & (F.col("text_crc32") == F.col("c")), "left")
    at = at.withColumns({"group_start": F.coalesce("wide_start", "group_start"), "group_bytes": F.coalesce("wide_bytes", "group_bytes")})
    # the shard in which the middle of the record, or of its group, lies
    middle = F.when(F.col("group_bytes") <= TOLERANCE * total / n_shards, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(total, 1))).cast("int")
    at = written(at.select("doc_id", "size", "text_crc32", "key", "place", shard.alias("shard")), "sharding-shards")
    for table in (ranged, ranges, places):
        dropped(table)
    first = at.groupBy("shard").agg(F.min("place").alias("first"))
    return at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "key", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_sharded(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 8) -> None:
    """Write all rows and columns of ``docs`` under ``path``, a folder for each shard, range-partitioned by the shards' first keys."""
    first = placed(docs, n_shards, id_col, text_col).groupBy("shard").agg(F.min(F.struct("key", "doc_id")).alias("at")).orderBy("shard").collect()
    kind = docs.schema[id_col].dataType
    cuts = F.array(*[F.struct(F.lit(r.at.key).alias("key"), F.lit(r.at.doc_id).cast(kind).alias("doc_id")) for r in first[1:]])
    numbers = F.array(*[F.lit(r.shard) for r in first]) if first else F.array(F.lit(0))
    value = F.struct(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(id_col).alias("doc_id"))
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    out = docs.withColumn(name, F.get(numbers, _count_up_to(cuts, value) if len(first) > 1 else F.lit(0)))
    out.repartition(n_shards * files_per_shard, F.col(name), F.xxhash64(F.col(text_col)) % files_per_shard).write.partitionBy(name).parquet(path)


def law(rows: DataFrame) -> DataFrame:
    """The columns that describe a placement by bytes."""
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))

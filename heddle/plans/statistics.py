"""Statistics of a table's columns, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_statistics(df: DataFrame, error: float = 0.02) -> DataFrame:
    """A row for each column: rows, share of nulls, distinct values (about, within ``error``), least and greatest as text."""
    columns = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    each = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.count(F.lit(1)).alias("n_rows"),
            (F.sum(F.col(f"`{f.name}`").isNull().cast("double")) / F.count(F.lit(1))).alias("null_share"),
            F.approx_count_distinct(F.col(f"`{f.name}`"), error).alias("n_distinct"),
            F.min(F.col(f"`{f.name}`")).cast("string").alias("least"),
            F.max(F.col(f"`{f.name}`")).cast("string").alias("greatest"),
        )
        for f in columns
    ]
    return df.agg(F.array(*each).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def histogram(df: DataFrame, column: str, buckets: int = 100) -> list:
    """Values that cut a column into buckets of about equal numbers of rows."""
    return df.agg(F.percentile_approx(column, [i / buckets for i in range(buckets + 1)], 10_000).alias("q")).first().q


def most_common(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values with their shares."""
    total = df.count()
    return df.groupBy(F.col(column).alias("value")).agg((F.count("*") / max(total, 1)).alias("share")).orderBy(F.desc("share"), "value").limit(n)

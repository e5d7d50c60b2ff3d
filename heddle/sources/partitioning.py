"""How a scan's rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from heddle.errors import StatementError


def partitioned(df: DataFrame, how: str, n: int, *columns: str) -> DataFrame:
    """Rows by ``range`` or ``hash`` of columns, in turn (``round_robin``), or ``adaptive``: by size as it turns out."""
    if how == "range":
        return df.repartitionByRange(n, *columns)
    if how == "hash":
        return df.repartition(n, *columns)
    if how == "round_robin":
        return df.repartition(n)
    if how == "adaptive":
        return df.hint("rebalance", *columns)
    raise StatementError(f"unknown partitioning {how}", "range, hash, round_robin or adaptive")

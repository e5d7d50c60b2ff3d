"""What Spark plans, for tests and for people."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, top first."""
    return re.findall(r"^[\s:+\-*]*(?:\(\d+\) )?([A-Z]\w+)", physical_plan(df), re.M)


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans are given to filter by."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def read_schemas(df: DataFrame) -> list[str]:
    """The columns that the scans read."""
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", physical_plan(df))


def shuffles(df: DataFrame) -> int:
    """Exchanges other than broadcasts."""
    return sum(name == "Exchange" for name in operators(df))

"""Expressions with the dialect's meaning, all of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pg_div(a: Column | str, b: Column | str) -> Column:
    """Whole-number division towards zero, and NULL by zero."""
    a, b = _column(a), _column(b)
    return F.when(b != 0, F.call_function("div", a, b))


def char_length(s: Column | str) -> Column:
    """Characters of a string, not bytes."""
    return F.char_length(_column(s))


def truth(x: Column | str) -> Column:
    """Whether a condition is true; NULL is not."""
    return F.coalesce(_column(x).cast("boolean"), F.lit(False))

"""Registered queries, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.sources import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _spark_text(sql: str) -> str:
    return sql.replace("TS'", "TIMESTAMP_NTZ'")


def _plain_text(sql: str) -> str:
    return sql.replace("TS'", "TIMESTAMP '")


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """A query in SQL; ``TS'...'`` is a timestamp without zone. ``oracle`` is the other side's text if it differs."""
    text = _spark_text(sql)
    QUERIES[name] = lambda spark, sf_dir: with_tables(spark, sf_dir, text)
    ORACLE[name] = _plain_text(oracle if oracle is not None else sql)


def frame_query(oracle: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLE[key] = _plain_text(oracle)
        return f

    return add

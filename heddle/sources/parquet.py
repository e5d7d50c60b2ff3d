"""Parquet tables of a folder, one file or folder for each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once in a process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def used_tables(sql: str) -> list[str]:
    """Which of the known tables a query's text names."""
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def with_tables(spark: SparkSession, sf_dir: str, sql: str, args: dict | None = None) -> DataFrame:
    """A query over the folder's tables."""
    for name in used_tables(sql):
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql, args=args) if args else spark.sql(sql)

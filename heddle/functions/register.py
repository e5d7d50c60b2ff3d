"""Python functions for use in SQL, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> None:
    """A function of series to a series of the same length, as ``name(...)``."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable[..., object], returns: str) -> None:
    """A function of a group's series to one value, as an aggregate."""

    def whole(values: pd.Series) -> float:
        return f(values)

    spark.udf.register(name, F.pandas_udf(whole, returns, F.PandasUDFType.GROUPED_AGG))


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class with ``eval``, which yields rows, as a table function."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))

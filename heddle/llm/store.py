"""Tables cut from their lineage, in the folder that all executors share, and columns by their own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.shared import cleared, dropped, shared_dir, written

__all__ = ["cleared", "columns_of", "dropped", "shared_dir", "written"]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]

"""Tables read and written."""

from .parquet import read_table, used_tables, with_tables
from .partitioning import partitioned

__all__ = ["partitioned", "read_table", "used_tables", "with_tables"]

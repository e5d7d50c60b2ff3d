"""Functions that the dialect has and Spark lacks, and registration of functions in Python."""

from .dialect import char_length, pg_div, truth
from .register import register_aggregate, register_scalar, register_table

__all__ = ["char_length", "pg_div", "register_aggregate", "register_scalar", "register_table", "truth"]

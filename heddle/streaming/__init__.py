"""Tables and materialized views that follow a stream."""

from .refresh import follow

__all__ = ["follow"]

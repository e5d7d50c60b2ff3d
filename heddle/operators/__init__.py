"""The reference's query operators, each as a registered query with SQL to compare with."""

from . import aggregates, changes, composites, extras, joins, scans, setops, subqueries, windows
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregates", "changes", "composites", "extras", "joins", "scans", "setops", "subqueries", "windows"]

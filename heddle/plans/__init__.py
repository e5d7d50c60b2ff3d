"""Statements, rewrites, and plans as Spark shows them."""

"""Spark-native relational analytics."""

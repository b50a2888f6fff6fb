"""Lattica: typed, deeply nested data as Spark columns."""

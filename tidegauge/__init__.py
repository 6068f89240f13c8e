"""Ordered-series analytics on Spark."""

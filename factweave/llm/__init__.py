"""Operators for large text and training-data pipelines. Nothing outside this package imports it."""

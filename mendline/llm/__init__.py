"""Operators for training-data pipelines over text; nothing outside this package imports it."""

"""Spark operators for ordered, keyed survey tables."""

__version__ = "0.1.0"

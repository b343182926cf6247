"""Spark-first engine for self-describing, block-structured engineering data."""

__version__ = "0.1.0"

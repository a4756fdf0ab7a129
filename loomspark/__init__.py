"""A Spark-first extraction, frontier and corpus engine."""

__version__ = "0.1.0"

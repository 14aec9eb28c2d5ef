"""Tidemark: a Spark-first engine for market time series and strategy evaluation."""

__version__ = "0.1.0"

"""Spark-first analytics for spinning range-sensor recordings and live streams."""

__version__ = "0.1.0"

"""Spark-native SQL validation and analytics engine."""

__version__ = "0.1.0"

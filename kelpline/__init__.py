"""Spark-native engine for dense vectors and versioned key-value data."""

__version__ = "0.1.0"

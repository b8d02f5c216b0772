"""Spark-native analytics over framed signals, vectors and binary records."""

__version__ = "0.1.0"

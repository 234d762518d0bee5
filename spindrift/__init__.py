"""Spark-native analytics over vector collections, their metadata and their change feeds."""

__version__ = "0.1.0"

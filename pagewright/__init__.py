"""Spark-native page corpus processing: indexing, ranked retrieval and corpus cleaning."""

__version__ = "0.1.0"

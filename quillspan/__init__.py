"""Spark-native passage retrieval and evidence engine."""

__version__ = "0.1.0"

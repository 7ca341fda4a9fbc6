"""Spark-native data engine for retrieval-augmented question answering."""

__version__ = "0.1.0"

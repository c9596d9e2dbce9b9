"""Quillon: a Spark-native engine for a small relational dialect and its operators."""

__version__ = "0.1.0"

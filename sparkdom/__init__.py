"""Spark-native engine for querying web pages: HTML in, relational rows out."""

__version__ = "0.1.0"

"""Lodestrata: a PySpark-native engine for code and text retrieval."""

__version__ = "0.1.0"

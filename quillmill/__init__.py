"""Quillmill: a PySpark-native engine for note corpora and their retrieval."""

__version__ = "0.1.0"

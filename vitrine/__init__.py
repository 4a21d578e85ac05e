"""Catalog search, quality and relevance operators on PySpark DataFrames."""

__version__ = "0.1.0"

"""Spark-native structuring of document collections: text, grids, blocks, geometry, chunks, verdicts and reports."""

__version__ = "0.1.0"

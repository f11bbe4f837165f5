"""Lutrin: text indexing and query analysis for French bulletins, on Spark DataFrames."""

__version__ = "0.1.0"

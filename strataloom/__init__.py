"""Strataloom: a Spark-native engine for governed text and vector data."""

__version__ = "0.1.0"

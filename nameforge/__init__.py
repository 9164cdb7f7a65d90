"""Spark-native analytics over corpora of program functions."""

__version__ = "0.1.0"

"""Spark-native analytics over sets of regex detection rules."""

__version__ = "0.1.0"

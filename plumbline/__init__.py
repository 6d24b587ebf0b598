"""Spark-native evaluation of instruction following, and the data work around it."""

__version__ = "0.1.0"

"""Spark-native model scoring, drift monitoring and run tracking."""

__version__ = "0.1.0"

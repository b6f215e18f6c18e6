"""Spark-native analytics for high-definition road maps."""

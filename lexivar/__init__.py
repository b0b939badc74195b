"""Spark-native analytics for name recovery."""

"""Spark-native analytics, data-quality, drift-monitoring and text operators."""

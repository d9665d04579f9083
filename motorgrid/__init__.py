"""Spark-native vehicle-image data engine: labels, splits, retrieval, pages, queue."""

"""Spark-native analysis of frame-level animal track tables."""

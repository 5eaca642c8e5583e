"""Spark-native engine for approximate name screening."""

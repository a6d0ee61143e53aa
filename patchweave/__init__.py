"""Spark-native patch-selection analytics."""

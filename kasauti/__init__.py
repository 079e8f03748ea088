"""Spark-native robustness-evaluation engine."""

"""Spark-native analytics over clinical-trial registry data."""

"""Spark-native analytics over software history."""

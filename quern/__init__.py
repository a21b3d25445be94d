"""Spark-native analytics over code history, dependency graphs and text."""

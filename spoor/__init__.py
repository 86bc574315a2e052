"""Spark-native analytics over browser trace logs."""

"""Spark-native analytics over incident telemetry: DataFrame in, DataFrame out."""

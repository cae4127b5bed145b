"""Spark-native telemetry analytics and corpus preparation."""

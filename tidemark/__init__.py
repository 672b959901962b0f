"""Spark-native event-stream analytics."""

"""Spark-native analytics over AI-chat web-search logs."""

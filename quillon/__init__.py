"""Spark-native legal-text search and analytics."""

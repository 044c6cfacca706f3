"""Spark-native retrieval and record analytics."""

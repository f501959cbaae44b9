"""Spark-native semantic search and concept-graph engine."""

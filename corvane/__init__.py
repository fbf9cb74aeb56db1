"""Spark-native retrieval, graph and catalogue analytics."""

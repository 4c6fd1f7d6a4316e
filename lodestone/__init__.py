"""Lodestone: a Spark-native engine for retrieval and corpus analytics."""

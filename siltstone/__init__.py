"""Spark-native engine for corpus preparation, retrieval and retrieval evaluation."""

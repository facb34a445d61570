"""Spark-native engine for text and tabular feature pipelines."""

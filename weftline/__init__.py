"""Spark-native analytics over text corpora, model-output tables and conversations."""

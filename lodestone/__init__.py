"""Spark-native analytics for source-code corpora and review pipelines."""

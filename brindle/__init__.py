"""Spark-native processing of crawled training pages, run logs and text corpora."""

"""Spark-native screening and preparation of text at scale."""

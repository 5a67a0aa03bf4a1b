"""Spark-native document and table toolkit."""

"""Spark-native evidence retrieval and evaluation."""

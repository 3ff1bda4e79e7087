"""Spark-native preparation of training data."""

"""Spark-native document analytics: plans."""

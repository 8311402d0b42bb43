"""Spark-native document analytics: operators."""

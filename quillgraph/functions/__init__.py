"""Spark-native document analytics: functions."""

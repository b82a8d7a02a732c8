"""Spark-native churn scoring and retention analytics."""

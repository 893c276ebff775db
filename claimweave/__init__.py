"""Spark-native claim adjudication and extraction analytics."""

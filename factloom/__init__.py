"""Spark-native claim verification and dataset analytics."""

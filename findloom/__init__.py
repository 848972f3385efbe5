"""Spark-native consolidation of security-scanner findings."""

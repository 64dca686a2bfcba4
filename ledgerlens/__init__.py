"""Spark-native analytics over support-agent data."""

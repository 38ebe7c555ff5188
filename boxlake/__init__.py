"""Spark-native box-score analytics over any entity-by-date fact table."""

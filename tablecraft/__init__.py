"""Spark-native analytics for large tables: profile, clean, derive, chart, model."""

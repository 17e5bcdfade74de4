"""Spark-native ingestion, full-text search and reconciliation over public-records collections."""

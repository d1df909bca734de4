"""Gaugeline: a Spark-native engine for scoring and checking engineering drawings."""

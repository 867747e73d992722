"""Millrace: a Spark-native batch analytics engine for file-delivered business data."""

"""Continuous ingestion, an extra beside the batch layers."""

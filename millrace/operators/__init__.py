"""Conformance, curation, KPI, dimension, fact and quality operators: DataFrame in, DataFrame out."""

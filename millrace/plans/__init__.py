"""Layers, warehouse, serving SQL and the job graph, composed from the operators."""

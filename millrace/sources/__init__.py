"""Schemas, file scans, landing discovery, versioned tables and a generator of dirty data."""

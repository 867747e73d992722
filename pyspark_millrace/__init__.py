"""Lets every session find the data source ``millrace``: Spark imports packages of this prefix by itself."""

from millrace.sources.named import Millrace as DefaultSource

__all__ = ["DefaultSource"]

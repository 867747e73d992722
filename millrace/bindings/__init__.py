"""The retail tables as views over the driver's tables."""

"""Spark operators for investigating the quality and shape of a table."""

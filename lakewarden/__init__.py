"""Metadata-governance analytics as plain Spark DataFrame transformations."""

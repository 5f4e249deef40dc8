"""Audit analytics for document inventories, expressed as Spark DataFrame transformations."""

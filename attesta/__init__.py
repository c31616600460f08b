"""Retrieval over controlled documents, expressed as Spark DataFrame operations."""

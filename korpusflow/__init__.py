"""Batch corpus building, retrieval, temporal checks and evaluation as Spark DataFrame operations."""

"""Granary: retrieval and document analytics as PySpark DataFrame plans."""

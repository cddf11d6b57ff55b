"""Lectern: book-collection analytics as PySpark jobs."""

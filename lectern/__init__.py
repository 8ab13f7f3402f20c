"""Lectern: Markdown knowledge-base indexing and search as Spark DataFrame plans."""

__version__ = "0.2.0"

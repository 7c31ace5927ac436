"""Versioned-dataset analytics on PySpark."""

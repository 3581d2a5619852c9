"""Temporal text analytics on PySpark."""

"""Keyed event-stream analytics on PySpark."""

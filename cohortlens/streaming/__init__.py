"""Incremental form of the load."""

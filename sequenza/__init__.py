"""Deterministic dataflow analytics on PySpark."""

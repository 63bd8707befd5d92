"""Ordered-store analytics on Spark: keyed tables, logs, extents, metadata, journals."""

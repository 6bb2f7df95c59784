"""Operators for large-scale training-data pipelines. Nothing else in geoloom imports this."""

"""Supplier intelligence on Spark: validation, entity resolution, matching, graph, spend, risk, profiling and evidence."""

__version__ = "0.1.0"

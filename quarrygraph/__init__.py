"""Spark-native analytics over code-context graphs: retrieval, traversal, impact, drift and federation."""

__version__ = "0.1.0"

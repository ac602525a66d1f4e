"""Spark-native grouping of related records: scores, networks, clusters, families."""

__version__ = "0.1.0"

"""Spark-native analytics for ontologies and linked data."""

"""Spark-native similarity and linkage analytics."""

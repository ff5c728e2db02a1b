"""Cinelode: a Spark-native engine for media-library and dubbing records."""

__version__ = "0.1.0"

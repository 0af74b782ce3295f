"""tidemark: Spark-native analytics for wide-swath sea-surface-height data."""

__version__ = "0.1.0"

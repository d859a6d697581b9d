"""weft: a Spark-native document-knowledge engine."""

__version__ = "0.1.0"

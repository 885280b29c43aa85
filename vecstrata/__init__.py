"""vecstrata: a Spark-native vector search and document store engine."""

__version__ = "0.1.0"

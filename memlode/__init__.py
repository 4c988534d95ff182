"""memlode: a Spark-native analytics engine for text-memory collections."""

__version__ = "0.1.0"

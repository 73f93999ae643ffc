"""memloom: Spark-native analytics over text memories and knowledge graphs."""

__version__ = "0.1.0"

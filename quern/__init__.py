"""quern: a PySpark-native text-analytics and retrieval engine."""

__version__ = "0.1.0"

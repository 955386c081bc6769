"""graphloom: a PySpark-native engine for code-graph context assembly and dataset algebra."""

__version__ = "0.1.0"

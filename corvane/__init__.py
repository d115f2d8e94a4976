"""corvane: a PySpark-native engine for document retrieval, evaluation analytics and run-log processing."""

__version__ = "0.1.0"

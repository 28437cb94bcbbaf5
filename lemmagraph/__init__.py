"""lemmagraph: a PySpark-native engine for libraries of scholarly results."""

__version__ = "0.1.0"

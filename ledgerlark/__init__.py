"""ledgerlark: a PySpark-native engine for monitoring public statements."""

__version__ = "0.1.0"

"""marlstone: a PySpark-native analytics engine for catalog-style data."""

__version__ = "0.1.0"

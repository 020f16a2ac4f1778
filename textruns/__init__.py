"""textruns: a PySpark-native engine for exact search and statistics over repetitive text."""

__version__ = "0.1.0"

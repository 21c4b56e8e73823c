"""helixframe: a PySpark-native analytics engine for nested variant tables."""

__version__ = "0.1.0"

"""marlspike: a PySpark-native analytics engine for code and text intelligence."""

__version__ = "0.1.0"

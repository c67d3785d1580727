"""loomlog: a PySpark-native analytics engine for versioned key-value logs."""

__version__ = "0.1.0"

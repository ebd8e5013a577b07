"""codelattice: a PySpark-native engine for querying source code as data."""

__version__ = "0.1.0"

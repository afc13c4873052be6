"""millrace: a PySpark-native engine for single-table analytics and corpus-scale data processing."""

__version__ = "0.1.0"

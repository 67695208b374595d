"""fundflow: a PySpark-native engine for fund-flow and forensic graph analytics."""

__version__ = "0.1.0"

"""Spark-native operators for large panels of monthly, regime-annotated time series."""

__version__ = "0.1.0"

"""Drift and anomaly analytics as ordinary PySpark DataFrame functions."""

__version__ = "0.1.0"

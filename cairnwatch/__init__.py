"""Cairnwatch: a Spark-first engine for threat-text analytics."""

__version__ = "0.1.0"

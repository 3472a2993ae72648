"""Delay and service-level analytics over movement facts, as Spark DataFrame operators."""

__version__ = "0.1.0"

"""Vinculum: linked-evidence analytics as composable DataFrame operators on Apache Spark."""

__version__ = "0.1.0"

"""Lesson documents to a cleaned fact base, a resolved graph and a validated assessment table, on Spark."""

__version__ = "0.1.0"

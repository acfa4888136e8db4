"""Auditloom: site-audit analytics as lazy PySpark transformations."""

__version__ = "0.1.0"

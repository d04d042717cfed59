"""Loan-portfolio analytics as PySpark DataFrame, SQL and MLlib jobs."""

__version__ = "0.1.0"

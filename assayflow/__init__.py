"""Filings analytics expressed as PySpark DataFrame operators."""

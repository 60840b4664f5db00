"""Tallyrock: relational and training-data operators for PySpark."""

"""Ensemble-extremes analytics as PySpark DataFrame transformations."""

"""Whole analyses, and the driver's tables in the shapes they need."""

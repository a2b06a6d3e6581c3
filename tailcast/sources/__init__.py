"""Reading, the fixed chain of preparations, writing."""

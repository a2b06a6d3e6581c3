"""Column functions: units, indices, return periods, the GEV distribution."""

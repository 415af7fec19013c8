"""Column-level functions: text, geometry, projection."""

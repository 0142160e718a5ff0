"""Column functions: names, values, categories."""

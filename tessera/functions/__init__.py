"""Column functions: identifier tokenisers, string helpers."""

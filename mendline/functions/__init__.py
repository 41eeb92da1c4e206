"""Column functions: digests, periods and texts."""

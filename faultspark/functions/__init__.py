"""Column functions: numbers, keyed randomness, geodesy."""

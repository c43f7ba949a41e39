"""Column expressions: chemistry and features."""

"""Column expressions: each takes columns and gives a column."""

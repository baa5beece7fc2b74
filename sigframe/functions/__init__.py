"""Column functions: each returns a Catalyst expression."""

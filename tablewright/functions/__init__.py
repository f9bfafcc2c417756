"""Column expressions: scalars, date tests, keyed draws."""

"""Column expressions: no function here looks at data."""

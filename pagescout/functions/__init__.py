"""Column expressions and column steps."""

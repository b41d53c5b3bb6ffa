"""Column expressions and small relational building blocks."""

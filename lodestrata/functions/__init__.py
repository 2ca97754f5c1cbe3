"""Column expressions and row parsers."""

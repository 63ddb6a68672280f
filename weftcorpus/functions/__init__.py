"""Column expressions and the rules that they match."""

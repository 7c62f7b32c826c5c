"""Column expressions and two-grain measures."""

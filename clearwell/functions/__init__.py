"""Column expressions and the fixed rule tables they use."""

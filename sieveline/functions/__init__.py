"""Column expressions: text, keys, similarities."""

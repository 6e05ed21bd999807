"""Column functions: patterns, text, similarity."""

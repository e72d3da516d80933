"""Column expressions: names and labels, statistics."""

"""Column expressions: predicates, text, vectors, interval covers."""

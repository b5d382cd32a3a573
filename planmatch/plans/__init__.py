"""Question shapes, stand-in inputs and the query registry."""

"""Graph operators: patterns, paths, writes, vectors, schemas and texts."""

"""Column-level helpers: hash draws, vectors, text."""

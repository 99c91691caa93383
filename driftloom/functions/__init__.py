"""Column-level helpers: names, scalar expressions, vectors, test statistics."""

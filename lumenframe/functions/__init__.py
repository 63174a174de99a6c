"""Column functions: casts, keys, geometry, vectors, images."""

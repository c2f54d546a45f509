"""Column functions: text, vectors, chunking."""

"""Column functions: text, time, vectors."""

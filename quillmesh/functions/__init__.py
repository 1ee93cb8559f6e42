"""Column functions: text, numbers and vectors."""

"""Column expressions: text, labels and keyed hashing."""

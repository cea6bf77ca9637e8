"""Column expressions: text, arithmetic and keyed hashing."""

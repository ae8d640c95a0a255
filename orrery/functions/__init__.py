"""Column expressions: geometry, text, time, vectors, rules, hashes."""

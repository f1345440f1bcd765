"""Column functions: text clean-up, rounding, and predicates over profile arrays."""

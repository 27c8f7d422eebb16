"""Column expressions: strings, types, values, predicates and extraction."""

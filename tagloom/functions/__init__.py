"""Column expressions: predicates, text, plan text, similarity, errors, JSON."""

"""Column expressions: predicates, scores, cleansing and rules."""

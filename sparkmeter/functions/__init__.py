"""Column expressions: labels, predicates, text counters."""

"""Column expressions: distances, filters, graph predicates, weights and text rules."""

"""Column expressions: cleaning, predicates, labels, geometry and date windows."""

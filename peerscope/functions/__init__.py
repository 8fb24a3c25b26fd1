"""Column expressions: measures, labels, robust scores."""

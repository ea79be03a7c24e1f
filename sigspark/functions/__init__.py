"""Column expressions: scalars and text, ranks, normal tails."""

"""Column expressions and plan helpers shared by the operators."""

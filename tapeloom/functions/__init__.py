"""Column expressions and join helpers shared by the operators."""

"""Column expressions and small Arrow helpers shared by the operators."""

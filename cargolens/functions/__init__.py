"""Column expressions and the skew-proof building blocks shared by the operators."""

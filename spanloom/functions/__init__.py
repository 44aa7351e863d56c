"""Column -> Column building blocks shared by the operators."""

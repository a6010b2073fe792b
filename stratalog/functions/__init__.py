"""Column expressions and vectorised functions of the record log."""

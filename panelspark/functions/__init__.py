"""Column expressions and rank plans."""

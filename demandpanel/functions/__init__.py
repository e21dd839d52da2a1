"""Column expressions: no jobs, no UDFs except the p-value tails."""

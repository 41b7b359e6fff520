"""Column expressions and regex helpers."""

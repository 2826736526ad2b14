"""Column expressions: numeric, text, geographic."""

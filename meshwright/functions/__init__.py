"""Column expressions on cells and coordinates."""

"""Grids, result objects and the registered queries."""

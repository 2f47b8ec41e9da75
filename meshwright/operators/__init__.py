"""Burn, crop, extract, materialise, aggregate and reshape operators; all of them plans of built-in expressions."""

"""Operators for building training corpora: one module per operator, none of them used elsewhere in the library."""

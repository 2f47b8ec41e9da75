"""Geometry-by-grid analytics on Spark: sparse burns of vector geometry as ordinary DataFrames."""

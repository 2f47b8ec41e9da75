"""Geometry inputs: WKB, WKT, coordinates and fixtures."""

"""Scalar measures of coordinate arrays and boxes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n >= 2, F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b")))


def signed_area(ring: Column) -> Column:
    """The signed area of a ring of (x, y), positive counter-clockwise, with x taken from the first point for accuracy; 0 below 3 points."""
    x = F.element_at(ring, 1)["x"]
    cross = F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + (p["a"]["x"] - x) * p["b"]["y"] - (p["b"]["x"] - x) * p["a"]["y"])
    return F.when(F.size(ring) >= 3, cross / 2).otherwise(0.0)


def length(line: Column) -> Column:
    """The planar length of a line of (x, y)."""
    d = F.aggregate(_pairs(line), F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], 2.0) + F.pow(p["b"]["y"] - p["a"]["y"], 2.0)))
    return F.coalesce(d, F.lit(0.0))


def envelope(ring: Column) -> Column:
    """The box of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def boxes_intersect(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (b["xmax"] <= a["xmax"]) & (a["ymin"] <= b["ymin"]) & (b["ymax"] <= a["ymax"])


def box_strictly_contains(a: Column, b: Column) -> Column:
    return (a["xmin"] < b["xmin"]) & (b["xmax"] < a["xmax"]) & (a["ymin"] < b["ymin"]) & (b["ymax"] < a["ymax"])


def box_intersection(a: Column, b: Column) -> Column:
    """The common box, null if there is none."""
    both = F.struct(*(f(a[n], b[n]).alias(n) for n, f in (("xmin", F.greatest), ("ymin", F.greatest), ("xmax", F.least), ("ymax", F.least))))
    return F.when(boxes_intersect(a, b), both)


def box_expand(a: Column, b: Column) -> Column:
    """The box that holds both."""
    return F.struct(*(f(a[n], b[n]).alias(n) for n, f in (("xmin", F.least), ("ymin", F.least), ("xmax", F.greatest), ("ymax", F.greatest))))


def box_translate(a: Column, dx: Column | float, dy: Column | float) -> Column:
    return F.struct((a["xmin"] + dx).alias("xmin"), (a["ymin"] + dy).alias("ymin"), (a["xmax"] + dx).alias("xmax"), (a["ymax"] + dy).alias("ymax"))

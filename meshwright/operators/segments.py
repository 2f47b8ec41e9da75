"""Geometry as a table of segments, and segments cut at grid lines.

Everything is a chain of explodes and arithmetic: one row a segment, then one a (segment, row), then one a (segment, row,
column). Segments are clipped to the grid's rows and to one column beside it on either side before the explodes, so a
geometry far larger than the grid costs no more than the cells it crosses. Rings come in chunks of vertices, so one polygon
can be many rows, in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.rings import signed_area
from meshwright.plans.grid import Grid

KEYS = ("id", "part", "row")


def segments(geometries: DataFrame) -> DataFrame:
    """id, kind, part, ring, seq, x0, y0, x1, y1 and (polygons) the winding weight of all lines and rings.

    geometries: id, kind, parts. Rings below four coordinates are left out, as are polygons whose exterior is one. The
    weight is +1 for a counter-clockwise exterior, and changes sign for clockwise rings and for holes.
    """
    parts = geometries.where(F.col("kind").isin("polygon", "line")).select("id", "kind", F.posexplode("parts").alias("part", "rings"))
    parts = parts.where((F.col("kind") == "line") | (F.size(F.get("rings", F.lit(0))) >= 4))
    rings = parts.select("id", "kind", "part", F.posexplode("rings").alias("ring", "c")).where(F.size("c") >= F.when(F.col("kind") == "line", 2).otherwise(4))
    return ring_segments(rings)


def ring_segments(rings: DataFrame) -> DataFrame:
    """Weighted segments of rings and lines (id, kind, part, ring, c), c an array of x, y.

    The turn of a ring is taken once: it is exploded together with the array, as Spark would else compute it again for each
    segment. Rings of very many vertices are better decoded in chunks (:func:`chunk_segments`).
    """
    turn = F.when(signed_area(F.col("c")) > 0, 1).otherwise(-1) * F.when(F.col("ring") == 0, 1).otherwise(-1)
    whole = F.struct(F.when(F.col("kind") == "polygon", turn).alias("w"), "c")
    once = rings.select("id", "kind", "part", "ring", F.explode(F.array(whole)).alias("s")).select("id", "kind", "part", "ring", "s.w", "s.c")
    return _paired(once.withColumn("first", F.lit(0)))


def chunk_segments(chunks: DataFrame) -> DataFrame:
    """Weighted segments of vertex chunks, see :func:`meshwright.sources.wkb.chunks_from_wkb`. Rings without a weight aren't burnt."""
    burnt = chunks.where("(kind = 'line' OR (kind = 'polygon' AND w <> 0)) AND size(c) >= 2")
    return _paired(burnt.select("id", "kind", "part", "ring", F.when(F.col("kind") == "polygon", F.col("w")).alias("w"), "c", "first"))


def _paired(rows: DataFrame) -> DataFrame:
    """Segments of arrays c, numbered from ``first``."""
    n = F.size("c")
    pairs = F.arrays_zip(F.slice("c", F.lit(1), n - 1).alias("a"), F.slice("c", F.lit(2), n - 1).alias("b"))
    each = rows.select("id", "kind", "part", "ring", "w", "first", F.posexplode(pairs).alias("at", "s"))
    return each.select("id", "kind", "part", "ring", (F.col("first") + F.col("at")).alias("seq"), *(F.col(f"s.{e}.{c}").alias(f"{c}{k}") for k, e in enumerate("ab") for c in "xy"), "w")


def chunk_points(chunks: DataFrame) -> DataFrame:
    """id, x, y of all points of vertex chunks."""
    return chunks.where("kind = 'point'").select("id", F.explode("c").alias("xy")).select("id", "xy.x", "xy.y")


def points(geometries: DataFrame) -> DataFrame:
    """id, x, y of all points."""
    each = geometries.where("kind = 'point'").select("id", F.explode("parts").alias("p")).select("id", F.explode("p").alias("c"))
    return each.select("id", F.explode("c").alias("xy")).select("id", "xy.x", "xy.y")


def on_grid(rows: DataFrame, grid: Grid) -> DataFrame:
    """Adds u, v: coordinates in cells from the upper left corner, v downward."""
    u = lambda c: (F.col(c) - grid.xmin) / grid.dx
    v = lambda c: (grid.ymax - F.col(c)) / grid.dy
    return rows.withColumns({"u0": u("x0"), "u1": u("x1"), "v0": v("y0"), "v1": v("y1")})


def explode_range(rows: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
    """One row for each whole number from ``low`` to ``high``; none if low is above high (a bare sequence would run downward)."""
    bounded = rows.withColumns({"lo__": low.cast("long"), "hi__": high.cast("long")})
    return bounded.withColumn(name, F.explode(F.when(F.col("lo__") <= F.col("hi__"), F.sequence("lo__", "hi__")))).drop("lo__", "hi__")


def cut(rows: DataFrame, grid: Grid, beside: bool) -> DataFrame:
    """One row for each cell that a segment passes, with t0, t1: where along the segment. rows: u0, v0, u1, v1.

    row and col are 0-based. ``beside``: columns beside the grid become the one column -1 or ncol, else they are left out.
    A segment along a grid line belongs to the cell below or right of it, at the far edges to the last row or column.
    """
    return cut_columns(cut_rows(rows, grid), grid, beside)


def rows_passed(rows: DataFrame, grid: Grid) -> tuple[DataFrame, Column, Column]:
    """The segments that reach the grid's rows, and the first and last row (0-based) of each."""
    low, high = F.least("v0", "v1"), F.greatest("v0", "v1")
    flat = F.col("v0") == F.col("v1")
    first = F.when(flat & (low == grid.nrow), F.lit(float(grid.nrow - 1))).otherwise(F.floor(low))
    last = F.when(flat, first).otherwise(F.ceil(high) - 1)
    near = (low <= grid.nrow) & (high >= 0) & (F.least("u0", "u1") <= grid.ncol)  # what is right of the grid adds nothing
    return rows.where(near), F.greatest(first, F.lit(0)), F.least(last, F.lit(grid.nrow - 1))


def cut_rows(rows: DataFrame, grid: Grid, band: int | None = None) -> DataFrame:
    """One row for each row of the grid that a segment passes, with ta, tb: where along the segment. See :func:`cut`. band: rows have a column band, and only the rows of that band, of so many rows, are taken."""
    dv, flat = F.col("v1") - F.col("v0"), F.col("v0") == F.col("v1")
    rows, first, last = rows_passed(rows, grid)
    if band is not None:
        first, last = F.greatest(first, F.col("band") * band), F.least(last, F.col("band") * band + band - 1)
    rows = explode_range(rows, "row", first, last)
    at = lambda k, start, d: (k - F.col(start)) / d
    one, two = at(F.col("row"), "v0", dv), at(F.col("row") + 1, "v0", dv)
    rows = rows.withColumn("ta", F.when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(one, two))))
    return rows.withColumn("tb", F.when(flat, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(one, two)))).where("ta < tb")


def cut_columns(rows: DataFrame, grid: Grid, beside: bool) -> DataFrame:
    """Rows of :func:`cut_rows` (u0, u1, ta, tb) cut at columns, with t0, t1. See :func:`cut`."""
    du = F.col("u1") - F.col("u0")
    at = lambda k, start, d: (k - F.col(start)) / d
    ua, ub = F.col("u0") + F.col("ta") * du, F.col("u0") + F.col("tb") * du
    left, right = F.least(ua, ub), F.greatest(ua, ub)
    upright = F.col("u0") == F.col("u1")
    edge = F.when(upright & (left == grid.ncol), F.lit(float(grid.ncol - 1))).otherwise(F.floor(left)) if not beside else F.floor(left)
    lo, hi = edge, F.when(upright, edge).otherwise(F.greatest(edge, F.ceil(right) - 1))
    if beside:
        lo, hi = F.greatest(F.least(lo, F.lit(grid.ncol)), F.lit(-1)), F.greatest(F.least(hi, F.lit(grid.ncol)), F.lit(-1))
    else:
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(grid.ncol - 1))
    rows = explode_range(rows, "col", lo, hi)
    one, two = at(F.col("col"), "u0", du), at(F.col("col") + 1, "u0", du)
    into, out = F.least(one, two), F.greatest(one, two)
    if beside:  # the columns beside the grid reach to infinity
        away = F.lit(float("inf"))
        into = F.when(((F.col("col") == -1) & (du > 0)) | ((F.col("col") == grid.ncol) & (du < 0)), -away).otherwise(into)
        out = F.when(((F.col("col") == -1) & (du < 0)) | ((F.col("col") == grid.ncol) & (du > 0)), away).otherwise(out)
    rows = rows.withColumn("t0", F.when(upright, F.col("ta")).otherwise(F.greatest("ta", into))).withColumn("t1", F.when(upright, F.col("tb")).otherwise(F.least("tb", out)))
    return rows.where("t0 < t1").withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}).drop("ta", "tb")

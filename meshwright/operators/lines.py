"""Line burns: the length of each line in each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.segments import cut_columns, cut_rows, explode_range, on_grid, rows_passed
from meshwright.plans.grid import Grid


#: Rows of the grid that a segment is dealt out for at once.
BAND = 8


def line_cells(segments: DataFrame, grid: Grid) -> DataFrame:
    """row, col, length, id: one row for each part of a geometry and cell that it passes; cells that are only touched are left out.

    Segments are dealt out by (id, part, band of rows) and cut at grid lines where they arrive. So what one task adds up is
    bounded by the size that Spark gives a partition behind an exchange, times the cells that a segment passes in a band, and
    not by how many cells the geometries of one partition of the input pass.
    """
    reach, first, last = rows_passed(on_grid(segments.where("kind = 'line'"), grid), grid)
    bands = explode_range(reach, "band", F.floor(first / BAND), F.floor(last / BAND))
    dealt = bands.select("id", "part", F.col("band").cast("int").alias("band"), "x0", "y0", "x1", "y1").repartition("id", "part", "band")
    pieces = cut_columns(cut_rows(on_grid(dealt, grid), grid, BAND), grid, beside=False)
    whole = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    pieces = pieces.select("id", "part", "band", "row", "col", (whole * (F.col("t1") - F.col("t0"))).alias("piece"))
    summed = pieces.groupBy("id", "part", "band", "row", "col").agg(F.sum("piece").alias("length")).where("length > 0")
    return summed.select((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "length", "id")

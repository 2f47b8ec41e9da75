"""Point burns: a filter and a projection, so they work on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.cells import col_of, inside, row_of
from meshwright.plans.grid import Grid


def point_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """row, col, id of points (id, x, y) on the extent or its edges; all others (NaN too) are left out, repeated ones kept."""
    x, y = F.col("x"), F.col("y")
    return points.where(inside(grid, x, y)).select(row_of(grid, y).alias("row"), col_of(grid, x).alias("col"), "id")

"""Cells as column expressions. All are built-in arithmetic, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwright.plans.grid import Grid


def inside(grid: Grid, x: Column, y: Column) -> Column:
    """True on the extent and its four edges; false for NaN."""
    return x.between(grid.xmin, grid.xmax) & y.between(grid.ymin, grid.ymax)


def col_of(grid: Grid, x: Column) -> Column:
    """The 1-based column of an x inside the extent: a grid line belongs to the column right of it, xmax to the last."""
    return (F.least(F.floor((x - grid.xmin) / grid.dx), F.lit(grid.ncol - 1)) + 1).cast("int")


def row_of(grid: Grid, y: Column) -> Column:
    """The 1-based row of a y inside the extent: a grid line belongs to the row below it, ymin to the last."""
    return (F.least(F.floor((grid.ymax - y) / grid.dy), F.lit(grid.nrow - 1)) + 1).cast("int")


def center_x(grid: Grid, col: Column) -> Column:
    return grid.xmin + (col - 0.5) * grid.dx


def center_y(grid: Grid, row: Column) -> Column:
    return grid.ymax - (row - 0.5) * grid.dy


def box(grid: Grid, row: Column, col: Column) -> Column:
    """The box of a cell as a struct; the last row and column end at the extent."""
    return F.struct(
        (grid.xmin + (col - 1) * grid.dx).alias("xmin"),
        F.when(row == grid.nrow, F.lit(grid.ymin)).otherwise(grid.ymax - row * grid.dy).alias("ymin"),
        F.when(col == grid.ncol, F.lit(grid.xmax)).otherwise(grid.xmin + col * grid.dx).alias("xmax"),
        (grid.ymax - (row - 1) * grid.dy).alias("ymax"),
    )


def tile_of(index: Column, size: int) -> Column:
    """The 0-based tile of a 1-based row or column."""
    return F.floor((index - 1) / size).cast("int")

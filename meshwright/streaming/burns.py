"""Burns of streams.

A point burn is a filter and a projection, so it is applied to a streaming DataFrame as it is. Polygon and line burns sum
over the pieces of each geometry: on a stream they run on each micro-batch, whose geometries are whole rows, or inside each
row (:mod:`meshwright.streaming.sweep`), which needs no micro-batch function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from meshwright.functions.cells import col_of, inside, row_of
from meshwright.operators.burn import BurnResult, burn
from meshwright.operators.points import point_cells
from meshwright.plans.grid import Grid


def stream_points(points: DataFrame, grid: Grid) -> DataFrame:
    """row, col, id of a stream of points (id, x, y)."""
    return point_cells(points, grid)


def windowed_counts(points: DataFrame, grid: Grid, time: str, width: str, late: str) -> DataFrame:
    """window, row, col, n: points (x, y, a time) for each window and cell; rows later than ``late`` are left out by the watermark."""
    x, y = F.col("x"), F.col("y")
    cells = points.withWatermark(time, late).where(inside(grid, x, y)).select(F.col(time), row_of(grid, y).alias("row"), col_of(grid, x).alias("col"))
    return cells.groupBy(F.window(time, width), "row", "col").agg(F.count("*").alias("n"))


def burn_batches(stream: DataFrame, grid: Grid, sink: Callable[[BurnResult, int], None], mode: str = "coverage") -> DataStreamWriter:
    """A writer that burns each micro-batch of WKB (id, wkb) and hands the tables to ``sink``, with the batch's number for idempotent writes."""

    def each(batch: DataFrame, number: int) -> None:
        result = burn(batch, grid=grid, mode=mode)
        try:
            sink(result, number)
        finally:
            result.unpersist()

    return stream.writeStream.foreachBatch(each)

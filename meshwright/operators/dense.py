"""Dense views: one value a cell, as a long table (row, col, value) or, for small grids, an array; and tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.cells import tile_of
from meshwright.operators.burn import BurnResult
from meshwright.operators.results import by_cell, check_single_kind, elementary, in_blocks, kinds_present, last_ids, measure_sums, pieces, value_runs
from meshwright.plans.grid import Grid

FUNCTIONS = ("first", "last", "sum", "min", "max", "count", "any")
#: A grid of more cells than this is not brought to the driver.
MOST_CELLS = 50_000_000


def _reduced(fn: str, background: float | None) -> Column:
    """The value of a cell from its writes (value, rank, id, part), in write order: all runs before all edges, each by id and part. A background other than NaN is there before them."""
    order, value = F.struct("rank", "id", "part"), F.col("value")
    if background is None or np.isnan(background):
        return {
            "first": F.min_by(value, order), "last": F.max_by(value, order), "sum": F.sum(value), "min": F.min(value), "max": F.max(value),
            "count": F.count("*").cast("double"), "any": F.lit(1.0),
        }[fn]
    b = F.lit(float(background))
    return {
        "first": b, "last": F.max_by(value, order), "sum": b + F.sum(value), "min": F.least(b, F.min(value)), "max": F.greatest(b, F.max(value)),
        "count": b + F.count("*"), "any": F.lit(1.0),
    }[fn]


def _reduced_runs(pieces: DataFrame, value: Column, width: int) -> DataFrame:
    """row, col_start, col_end, value: reduced over all pieces at each place, as runs of equal values."""
    cut = elementary(pieces, width).groupBy("row", "block", "col_start", "col_end").agg(value.alias("value"))
    return value_runs(cut, ["value"])


def materialize_runs(
    r: BurnResult, values: DataFrame | None = None, fn: str = "last", edge_policy: str = "threshold", threshold: float = 0.5,
    background: float | None = None, check: bool = True, width: int = 4096,
) -> DataFrame:
    """row, col_start, col_end, value of the cells that polygons touch, as runs of equal values. values: id, value (default: the id); boundary cells count whole from a share of ``threshold``, or by their share ("fraction").

    Rows are made for the ends of runs, not for their cells. A run of values ends where a block of ``width`` columns does.
    check: refuse lines and points (one job over the kinds of the input), as their measures are no shares.
    """
    if fn not in FUNCTIONS:
        raise ValueError(f"fn must be one of {', '.join(FUNCTIONS)}")
    if edge_policy not in ("threshold", "fraction"):
        raise ValueError("edge_policy must be 'threshold' or 'fraction'")
    if check:
        found = kinds_present(r)
        if len(found) > 1:
            raise ValueError(f"mixed geometry kinds ({', '.join(found)}); burn each kind on its own")
        if found and found != ["polygon"]:
            raise NotImplementedError(f"only polygons are materialised by this function, not {found[0]}s")
    spans = r.spans().withColumn("rank", F.when(F.col("share") == 1, 0).otherwise(1))
    if edge_policy == "threshold":
        spans = spans.where((F.col("rank") == 0) | (F.col("share") >= threshold))
    if values is None:
        spans = spans.withColumn("value", F.col("id").cast("double"))
    else:
        given = values.select("id", F.col("value").cast("double").alias("given"), F.lit(True).alias("known"))
        spans = spans.join(given, "id", "left").withColumn("value", F.when(F.col("known"), F.col("given")).otherwise(F.raise_error(F.concat(F.lit("no value for geometry id "), F.col("id").cast("string"))).cast("double")))
    if edge_policy == "fraction":
        spans = spans.withColumn("value", F.col("value") * F.col("share"))
    return _reduced_runs(spans.select("row", "col_start", "col_end", "rank", "id", "part", "value"), _reduced(fn, background), width)


def materialize(r: BurnResult, values: DataFrame | None = None, fn: str = "last", edge_policy: str = "threshold", threshold: float = 0.5, background: float | None = None, check: bool = True) -> DataFrame:
    """row, col, value: :func:`materialize_runs` with one row for each cell."""
    return by_cell(materialize_runs(r, values, fn, edge_policy, threshold, background, check), "value")


def chunk_runs(r: BurnResult, fun: str = "sum", check: bool = True, background: float = 0.0, width: int = 4096) -> DataFrame:
    """row, col_start, col_end, value of all tables: background and the sum of measures of one kind, or the id written last (runs, edges, lines, points)."""
    if fun not in ("sum", "id"):
        raise ValueError("fun must be 'sum' or 'id'")
    if fun == "sum" and check:
        check_single_kind(r, "the sum")
    found, value = (last_ids(pieces(r), width), F.col("last").cast("double")) if fun == "id" else (measure_sums(pieces(r), width), F.lit(float(background)) + F.col("total"))
    return value_runs(found.withColumn("value", value), ["value"])


def materialize_chunk(r: BurnResult, fun: str = "sum", check: bool = True) -> DataFrame:
    """row, col, value: :func:`chunk_runs` with one row for each cell."""
    return by_cell(chunk_runs(r, fun, check), "value")


def materialize_all(r: BurnResult, background: float = 0.0, allow_mixed: bool = False) -> DataFrame:
    """row, col, value: background plus the sum of all measures of each touched cell."""
    return by_cell(chunk_runs(r, "sum", not allow_mixed, background), "value")


def to_numpy(cells: DataFrame, grid: Grid, background: float = float("nan")) -> np.ndarray:
    """The array [nrow, ncol] of a small grid, from row, col, value."""
    if grid.nrow * grid.ncol > MOST_CELLS:
        raise ValueError(f"{grid.nrow} x {grid.ncol} cells are too many for one array; write tiles instead")
    out, found = np.full(grid.shape, background), cells.select("row", "col", "value").toPandas()
    out[found["row"].to_numpy() - 1, found["col"].to_numpy() - 1] = found["value"].to_numpy()
    return out


def from_dense(raster: DataFrame, id_column: str = "value") -> DataFrame:
    """Runs of equal non-null values along rows of a raster (row, col, value): the inverse of expansion."""
    cells = raster.where(F.col(id_column).isNotNull()).select("row", "col", F.col(id_column).alias("id"))
    order = Window.partitionBy("row", "id").orderBy("col")
    cells = cells.withColumn("island", F.col("col") - F.row_number().over(order))
    return cells.groupBy("row", "id", "island").agg(F.min("col").alias("col_start"), F.max("col").alias("col_end")).select("row", "col_start", "col_end", "id")


def tiled(r: BurnResult, size: int = 2048) -> DataFrame:
    """tile_row, tile_col, rank, row, col_start, col_end, id, part, measure: all tables with runs cut at the borders of tiles. Empty tiles have no rows."""
    cut = in_blocks(pieces(r), size)
    return cut.select(tile_of(F.col("row"), size).alias("tile_row"), F.col("block").alias("tile_col"), "rank", "row", "col_start", "col_end", "id", "part", "measure")


def tile_index(r: BurnResult, size: int = 2048) -> DataFrame:
    """tile_row, tile_col, cells: how many entries' cells each tile with any has."""
    return tiled(r, size).groupBy("tile_row", "tile_col").agg(F.sum(F.col("col_end") - F.col("col_start") + 1).alias("cells"))


def dense_tiles(r: BurnResult, size: int = 256) -> DataFrame:
    """tile_row, tile_col, values: the ids written last in each tile that has anything, as a row-major array of size * size doubles (NaN where there is none).

    What is written last is found before, on runs, so a tile's task holds each cell once however many geometries overlap there.
    """

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        row, a, b, v = (rows[c].to_numpy() for c in ("row", "col_start", "col_end", "value"))
        many = b - a + 1
        at = np.repeat((row - 1) % size * size + (a - 1) % size - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.full(size * size, np.nan)
        out[at] = np.repeat(v, many)
        values = pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(out))
        return pa.table({"tile_row": pa.array([key[0].as_py()], pa.int32()), "tile_col": pa.array([key[1].as_py()], pa.int32()), "values": values})

    cut = in_blocks(chunk_runs(r, "id"), size).withColumn("tile_row", tile_of(F.col("row"), size))
    return cut.select("tile_row", F.col("block").alias("tile_col"), "row", "col_start", "col_end", "value").groupBy("tile_row", "tile_col").applyInArrow(block, "tile_row int, tile_col int, values array<double>")

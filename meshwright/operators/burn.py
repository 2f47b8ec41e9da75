"""The burn: geometries and a grid in, up to five tables out."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import segments as sg
from meshwright.operators.lines import line_cells
from meshwright.operators.points import point_cells
from meshwright.operators.polygons import centres, coverage
from meshwright.plans.grid import Grid, extent_of, resolve
from meshwright.sources.wkb import chunks_from_wkb, from_sequence

MODES = ("coverage", "approx")
TABLES = ("runs", "edges", "lines", "points")
MOST_NOTES = 100


@dataclass(frozen=True)
class BurnResult:
    """The lazy tables of a burn. runs: row, col_start, col_end, id; edges: row, col, fraction, id; lines: row, col, length, id; points: row, col, id; notes: id, message."""

    grid: Grid
    runs: DataFrame
    edges: DataFrame
    lines: DataFrame
    points: DataFrame
    notes: DataFrame
    source: DataFrame | None = None
    #: row, col_start, col_end, share, part, id of runs and edges together, unless one of them was replaced; see :meth:`spans`.
    cells: DataFrame | None = None
    #: kind of the geometries, where that is known without a burn.
    kinds: DataFrame | None = None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.grid.bounds

    @property
    def shape(self) -> tuple[int, int]:
        return self.grid.shape

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}

    def with_tables(self, grid: Grid | None = None, **tables: DataFrame) -> BurnResult:
        kept = {n: getattr(self, n) for n in (*TABLES, "notes", "source", "cells", "kinds")}
        if {"runs", "edges"} & tables.keys():
            kept["cells"] = None
        return BurnResult(grid or self.grid, **(kept | tables))

    def spans(self) -> DataFrame:
        """row, col_start, col_end, share, part, id of all polygons: what reads this costs the boundary and the rows, not the cells."""
        if self.cells is not None:
            return self.cells
        runs = self.runs.select("row", "col_start", "col_end", F.lit(1.0).alias("share"), F.lit(0).alias("part"), "id")
        edges = self.edges.select("row", F.col("col").alias("col_start"), F.col("col").alias("col_end"), F.col("fraction").cast("double").alias("share"), F.lit(0).alias("part"), "id")
        return runs.unionByName(edges)

    def only(self, ids: list | DataFrame) -> BurnResult:
        """The rows of some ids: a list, or a DataFrame with a column id (a semi-join)."""
        keep = (lambda t: t.join(ids.select("id").distinct(), "id", "left_semi").select(*t.columns)) if isinstance(ids, DataFrame) else (lambda t: t.where(F.col("id").isin(list(ids))))
        return self.with_tables(**{n: keep(t) for n, t in (*self.tables().items(), ("cells", self.spans()))})

    def as_float32(self) -> BurnResult:
        """Fractions and lengths in single precision."""
        narrow = lambda t, c: t.withColumn(c, F.col(c).cast("float"))
        return self.with_tables(edges=narrow(self.edges, "fraction"), lines=narrow(self.lines, "length"), cells=narrow(self.spans(), "share"))

    def unpersist(self) -> None:
        """Lets go of decoded geometries that were kept for all tables."""
        if self.source is not None:
            self.source.unpersist()

    def warn(self) -> None:
        """Raises a warning for each of the first ``MOST_NOTES`` notes, and one for the number of the others; these are two jobs."""
        n = self.notes.count()
        for r in self.notes.orderBy("id").limit(MOST_NOTES).collect():
            warnings.warn(f"geometry {r['id']}: {r['message']}", stacklevel=2)
        if n > MOST_NOTES:
            warnings.warn(f"{n - MOST_NOTES} more geometries have notes", stacklevel=2)


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return mode


def _empty(spark: SparkSession, **columns: str) -> DataFrame:
    """No rows of these columns and types, which the optimiser knows to be none."""
    return spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in columns.items())).limit(0)


def burn_segments(
    rows: DataFrame, points: DataFrame | None, grid: Grid, mode: str = "coverage", notes: DataFrame | None = None, source: DataFrame | None = None, combine: bool = True, kind: str | None = None
) -> BurnResult:
    """A burn of weighted segments (see :func:`segments.segments`) and points (id, x, y).

    combine: see :func:`polygons.coverage`; False for rings of few vertices a cell. kind: the only kind of geometry there is,
    if that is known; the tables of the others are then empty without a look at the input.
    """
    _checked(mode)
    spark, key = rows.sparkSession, dict(rows.dtypes)["id"]
    runs, edges = _empty(spark, row="int", col_start="int", col_end="int", id=key), _empty(spark, row="int", col="int", fraction="double", id=key)
    lines, cells = _empty(spark, row="int", col="int", length="double", id=key), _empty(spark, row="int", col="int", id=key)
    both = _empty(spark, row="int", col_start="int", col_end="int", share="double", part="int", id=key)
    if kind in (None, "polygon"):
        if mode == "coverage":
            runs, edges, both = coverage(rows, grid, combine=combine)
        else:
            runs, both = centres(rows, grid)
    if kind in (None, "line"):
        lines = line_cells(rows, grid)
    if points is not None and kind in (None, "point"):
        cells = point_cells(points, grid)
    kinds = source.where("error IS NULL").select("kind") if source is not None else rows.select("kind") if points is None else None
    kinds = kinds if kind is None else spark.range(1).select(F.lit(kind).alias("kind"))
    return BurnResult(grid, runs, edges, lines, cells, notes if notes is not None else _empty(spark, id=key, message="string"), source, both, kinds)


def coordinates(geometries: DataFrame) -> DataFrame:
    """x, y of all vertices of geometries (parts)."""
    each = geometries.select(F.explode("parts").alias("p")).select(F.explode("p").alias("c")).select(F.explode("c").alias("xy"))
    return each.select("xy.x", "xy.y")


def burn_geometries(geometries: DataFrame, bounds=None, shape=None, resolution=None, size: int = 256, mode: str = "coverage", grid: Grid | None = None) -> BurnResult:  # noqa: ANN001
    """A burn of decoded geometries (id, kind, parts, error). Without a grid or bounds, one job finds the extent."""
    _checked(mode)
    if grid is None:
        grid = resolve(bounds if bounds is not None else extent_of(coordinates(geometries)), shape, resolution, size)
    notes = geometries.where("error IS NOT NULL").select("id", F.col("error").alias("message"))
    return burn_segments(sg.segments(geometries), sg.points(geometries), grid, mode, notes, geometries)


#: Rings of more vertices than this are dealt out chunk by chunk.
LONG_RING = 1 << 16


def burn_chunks(chunks: DataFrame, bounds=None, shape=None, resolution=None, size: int = 256, mode: str = "coverage", grid: Grid | None = None, spread: bool = True) -> BurnResult:  # noqa: ANN001
    """A burn of vertex chunks. Without a grid or bounds, one job finds the extent. spread: deal long rings out over tasks, which reads the chunks twice."""
    _checked(mode)
    if grid is None:
        xy = chunks.select(F.explode("c").alias("xy")).select("xy.x", "xy.y")
        grid = resolve(bounds if bounds is not None else extent_of(xy), shape, resolution, size)
    dealt = chunks
    if spread:
        long = F.coalesce(F.col("n"), F.lit(0)) > LONG_RING
        dealt = chunks.where(~long).unionByName(chunks.where(long).repartition("id", "part", "ring", "first"))
    notes = chunks.where("error IS NOT NULL").select("id", F.col("error").alias("message"))
    return burn_segments(sg.chunk_segments(dealt), sg.chunk_points(chunks), grid, mode, notes, chunks)


def burn(df: DataFrame, bounds=None, shape=None, resolution=None, size: int = 256, mode: str = "coverage", id: str = "id", wkb: str = "wkb", grid: Grid | None = None, keep: bool = True) -> BurnResult:  # noqa: ANN001, A002
    """A burn of WKB, decoded into chunks of vertices. keep: decode once for all tables (storage level memory and disk) until :meth:`BurnResult.unpersist`, and deal long rings out over tasks."""
    _checked(mode)
    chunks = chunks_from_wkb(df, id, wkb)
    return burn_chunks(chunks.persist() if keep else chunks, bounds, shape, resolution, size, mode, grid, spread=keep)


def burn_values(spark: SparkSession, values: object, **how) -> BurnResult:  # noqa: ANN003
    """A burn of an in-memory sequence of WKB or geometry objects; ids are 1-based positions, and None takes one."""
    return burn(from_sequence(spark, values), **how)


def burn_scanline(df: DataFrame, **how) -> BurnResult:  # noqa: ANN003
    """Deprecated name of the coverage burn."""
    warnings.warn("burn_scanline is deprecated; use burn", DeprecationWarning, stacklevel=2)
    return burn(df, **(how | {"mode": "coverage"}))


def burn_sparse(*_: object, **__: object) -> None:
    """Removed name."""
    raise NotImplementedError("burn_sparse is no longer available; use burn")

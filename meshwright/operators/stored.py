"""Burns and values in files: ordered along a curve over the grid, with a list of what each file covers, and read back by window.

Entries are cut at the borders of square tiles and range-partitioned by (tile along a Z-order curve, row, column). Ranges are
balanced by rows, so many small tiles share a file and a hot tile is several. The list of files (the manifest) has each one's
rows and columns; a window opens only the files that reach it, and row groups inside are skipped by their statistics.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.cells import tile_of
from meshwright.operators.burn import BurnResult
from meshwright.operators.dense import chunk_runs
from meshwright.operators.results import in_blocks, pieces
from meshwright.plans.grid import Grid


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; inside the warehouse if that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/burn-{uuid.uuid4().hex}"


def z_order(a: Column, b: Column) -> Column:
    """The place of (a, b) on a Z-order curve: the bits of two numbers below 2**31, taken in turns."""

    def spread(c: Column) -> Column:
        c = c.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(spread(a), 1).bitwiseOR(spread(b))


def write_ordered(spans: DataFrame, path: str, size: int = 2048, files: int | None = None) -> None:
    """Spans (row, col_start, col_end, further columns), cut at tiles of ``size`` cells, as Parquet below ``path``/data, and ``path``/manifest."""
    spark = spans.sparkSession
    cut = in_blocks(spans, size).withColumn("tile_row", tile_of(F.col("row"), size)).withColumnRenamed("block", "tile_col")
    order = [z_order(F.col("tile_row"), F.col("tile_col")), F.col("row"), F.col("col_start")]
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{path}/data")
    box = (F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col_start").alias("col_lo"), F.max("col_end").alias("col_hi"), F.count("*").alias("entries"))
    spark.read.parquet(f"{path}/data").groupBy(F.input_file_name().alias("file")).agg(*box).coalesce(1).write.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The spans of a window (first and last row, first and last column), clipped to it, or all; files beyond the window aren't opened."""
    if window is None:
        return spark.read.parquet(f"{path}/data").drop("tile_row", "tile_col")
    row_lo, row_hi, col_lo, col_hi = window
    schema = spark.read.parquet(f"{path}/data").schema
    near = spark.read.parquet(f"{path}/manifest").where(f"row_lo <= {row_hi} AND row_hi >= {row_lo} AND col_lo <= {col_hi} AND col_hi >= {col_lo}")
    names = [r["file"] for r in near.select("file").collect()]  # no more than the files there are, as in any listing
    found = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    found = found.where(f"row BETWEEN {row_lo} AND {row_hi} AND col_start <= {col_hi} AND col_end >= {col_lo}").drop("tile_row", "tile_col")
    return found.withColumns({"col_start": F.greatest("col_start", F.lit(col_lo)), "col_end": F.least("col_end", F.lit(col_hi))})


def write_burn(r: BurnResult, path: str, size: int = 2048, files: int | None = None) -> None:
    """All tables of a burn, ordered, so that crops and lookups by place read a part of them."""
    write_ordered(pieces(r), path, size, files)


def read_burn(spark: SparkSession, path: str, grid: Grid, bounds: tuple[float, float, float, float] | None = None) -> BurnResult:
    """A burn from :func:`write_burn`, or its part in a box (xmin, ymin, xmax, ymax) as :func:`results.crop` gives it. grid: the one it was made on. Runs end at tiles."""
    window = (1, grid.nrow, 1, grid.ncol) if bounds is None else grid.window(*bounds)
    if window is None:
        raise ValueError("the box and the grid's extent don't overlap")
    row_lo, _, col_lo, _ = window
    spans = read_ordered(spark, path, None if bounds is None else window)
    spans = spans.withColumns({"row": F.col("row") - (row_lo - 1), "col_start": F.col("col_start") - (col_lo - 1), "col_end": F.col("col_end") - (col_lo - 1)})
    cell = lambda k, *more: spans.where(F.col("rank") == k).select("row", F.col("col_start").alias("col"), *more, "id")
    edges = spans.where("rank = 1").select("row", F.explode(F.sequence("col_start", "col_end")).alias("col"), F.col("measure").alias("fraction"), "id")
    return BurnResult(
        grid.sub(*window), spans.where("rank = 0").select("row", "col_start", "col_end", "id"), edges, cell(2, F.col("measure").alias("length")), cell(3),
        spans.select("id", F.lit("").alias("message")).limit(0), None, spans.where("rank <= 1").select("row", "col_start", "col_end", F.col("measure").alias("share"), "part", "id"),
    )


def write_tiles(r: BurnResult, path: str, size: int = 2048, files: int | None = None) -> None:
    """The ids written last, as runs, in ordered files: tiles without any have no rows."""
    write_ordered(chunk_runs(r, "id"), path, size, files)


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """row, col_start, col_end, value of a window of :func:`write_tiles`, or all."""
    return read_ordered(spark, path, window)

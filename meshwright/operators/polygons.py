"""Polygon burns: exact coverage, and cell centres.

Coverage sums two numbers a cell over the pieces of a ring's boundary: how far the piece runs down (cover) and the area
right of it inside the cell (area). By Green's theorem the running sum of covers left of a cell plus its area is the share
of the cell inside the polygon. Each task adds up its pieces by cell before they are exchanged, so no more than the
boundary cells travel, unless rings are known to have few vertices a cell: then adding up before spares nothing, and pieces
are dealt out once. Running sums go by (id, part, row); on grids wider than ``BLOCK`` columns they go by blocks of
columns first, and the blocks' totals are added, so no row of a grid has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.segments import KEYS, cut, explode_range, on_grid
from meshwright.plans.grid import Grid

#: Shares up to this are nothing, and from one minus this on all of a cell.
TOLERANCE = 1e-6
#: Columns that one running sum goes over.
BLOCK = 1 << 20


def scanned(rows: DataFrame, value: str | None, col: str, ncol: int, block: int = BLOCK) -> DataFrame:
    """Adds next (the col of the next row, or ncol) and, of a ``value``, before (the sum left of the row's block of columns) and after (the running sum up to and with the row).

    Of rows of one col, the last one's running sum is that of all; the others are followed by their own col.
    """
    last = F.lit(ncol)
    along = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if ncol <= block:
        order = Window.partitionBy(*KEYS).orderBy(col)
        sums = {} if value is None else {"before": F.lit(0).cast(dict(rows.dtypes)[value]), "after": F.sum(value).over(along(order))}
        return rows.withColumns(sums | {"next": F.coalesce(F.lead(col).over(order), last)})
    rows = rows.withColumn("block", F.floor(F.col(col) / block))
    order, blocks = Window.partitionBy(*KEYS, "block").orderBy(col), Window.partitionBy(*KEYS).orderBy("block")
    sums = {} if value is None else {"after": F.sum(value).over(along(order))}
    inside = rows.withColumns(sums | {"next": F.lead(col).over(order)})
    total = F.lit(0) if value is None else F.col(value)
    of_blocks = rows.groupBy(*KEYS, "block").agg(F.sum(total).alias("total"), F.min(col).alias("first"))
    left = F.coalesce(F.sum("total").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_blocks = of_blocks.select(*KEYS, "block", left.alias("before"), F.lead("first").over(blocks).alias("follows"))
    both = inside.join(of_blocks, [*KEYS, "block"])
    sums = {} if value is None else {"after": F.col("before") + F.col("after")}
    return both.withColumns(sums | {"next": F.coalesce("next", "follows", last)}).drop("block", "follows")


def _from_one(rows: DataFrame, *more: str) -> DataFrame:
    """Rows and columns counted from 1."""
    return rows.select((F.col("row") + 1).alias("row"), (F.col("col_start") + 1).cast("int").alias("col_start"), (F.col("col_end") + 1).cast("int").alias("col_end"), *more, "id")


def merged_runs(spans: DataFrame, ncol: int, block: int = BLOCK) -> DataFrame:
    """Maximal runs of disjoint spans (id, part, row, col_start, col_end), 0-based, as 1-based (row, col_start, col_end, id). On grids wider than ``block`` a run may end where a block does."""
    keys = KEYS if ncol <= block else (*KEYS, "block")
    order = Window.partitionBy(*keys).orderBy("col_start")
    rows = spans if ncol <= block else spans.withColumn("block", F.floor(F.col("col_start") / block))
    rows = rows.select(*keys, "col_start", F.lag("col_end").over(order).alias("left"), F.max("col_end").over(Window.partitionBy(*keys)).alias("end"))
    starts = rows.where("left IS NULL OR left + 1 < col_start")
    return _from_one(starts.withColumn("col_end", F.coalesce(F.lead("left").over(order), F.col("end"))))


def coverage_cells(segments: DataFrame, grid: Grid, block: int = BLOCK, combine: bool = True) -> DataFrame:
    """id, part, row, col_start, col_end, share (0-based): boundary cells, and the gaps between them, with the share that is inside."""
    pieces = cut(on_grid(segments.where("kind = 'polygon' AND y0 <> y1"), grid), grid, beside=True)
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    cover = F.col("w") * dv * (F.col("t1") - F.col("t0"))
    middle = F.col("u0") + du * (F.col("t0") + F.col("t1")) / 2
    share = F.when(F.col("col") < 0, F.lit(1.0)).when(F.col("col") >= grid.ncol, F.lit(0.0)).otherwise(1 - (middle - F.col("col")))
    cells = pieces.select("id", "part", "row", "col", cover.alias("cover"), (cover * share).alias("area"))
    cells = cells if combine or grid.ncol > block else cells.repartition(*KEYS)
    cells = cells.groupBy(*KEYS, "col").agg(F.sum("cover").alias("cover"), F.sum("area").alias("area"))
    cells = scanned(cells, "cover", "col", grid.ncol, block)
    boundary = F.struct(F.col("col").alias("a"), F.col("col").alias("b"), (F.col("after") - F.col("cover") + F.col("area")).alias("share"))
    gap = F.struct((F.col("col") + 1).alias("a"), (F.least("next", F.lit(grid.ncol)) - 1).alias("b"), F.col("after").alias("share"))
    both = cells.select(*KEYS, F.explode(F.array(boundary, gap)).alias("s")).select(*KEYS, F.col("s.a").alias("col_start"), F.col("s.b").alias("col_end"), "s.share")
    return both.where(f"col_start <= col_end AND col_start >= 0 AND col_end < {grid.ncol} AND share > {TOLERANCE}")


def coverage(segments: DataFrame, grid: Grid, block: int = BLOCK, combine: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, edges, cells) of polygon segments: cells wholly inside as maximal runs, others with the share of their area, and both in one table (:func:`spans`)."""
    cells = coverage_cells(segments, grid, block, combine)
    runs = merged_runs(cells.where(f"share >= {1 - TOLERANCE}"), grid.ncol, block)
    part = explode_range(cells.where(f"share < {1 - TOLERANCE}"), "col", F.col("col_start"), F.col("col_end"))
    edges = part.select((F.col("row") + 1).alias("row"), (F.col("col") + 1).cast("int").alias("col"), F.col("share").alias("fraction"), "id")
    return runs, edges, spans(cells)


def spans(cells: DataFrame) -> DataFrame:
    """row, col_start, col_end, share, part, id (1-based) of cells from :func:`coverage_cells`: what needs runs and edges together reads the burn once."""
    share = F.when(F.col("share") >= 1 - TOLERANCE, F.lit(1.0)).otherwise(F.col("share"))
    return _from_one(cells.withColumn("share", share), "share", "part")


def centres(segments: DataFrame, grid: Grid, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(runs, cells) of the cells whose centres have a winding number other than zero. A centre on a boundary counts at its left and upper side.

    What is exchanged is one row for each crossing of a row's middle. A run begins where the winding number leaves zero and
    ends before it comes back, so running sums and neighbours are all it takes.
    """
    rows = segments.where("kind = 'polygon' AND y0 <> y1").where(F.least("x0", "x1") <= grid.xmax)
    below, above = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.ceil((grid.ymax - above) / grid.dy - 0.5 - 1e-10)
    last = F.ceil((grid.ymax - below) / grid.dy - 0.5 - 1e-10) - 1
    rows = explode_range(rows, "row", F.greatest(first, F.lit(0)), F.least(last, F.lit(grid.nrow - 1)))
    y = grid.ymax - (F.col("row") + 0.5) * grid.dy
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    rows = rows.withColumn("x", x).withColumn("down", F.col("w") * F.when(F.col("y0") >= y, -1).otherwise(1))
    near = F.least(F.greatest(F.floor((F.col("x") - grid.xmin) / grid.dx), F.lit(-1)), F.lit(grid.ncol))
    begins = F.when(F.col("x") <= grid.xmin + (near + 0.5) * grid.dx, near).otherwise(near + 1)
    begins = F.least(F.greatest(begins, F.lit(0)), F.lit(grid.ncol)).cast("int")
    starts = rows.select("id", "part", F.col("row").cast("int").alias("row"), begins.alias("col_start"), "down")
    # crossings of one column share a running sum; all but the last of them are followed by their own column
    levels = scanned(starts, "down", "col_start", grid.ncol, block).where("col_start < next")
    levels = levels.select(*KEYS, "col_start", (F.col("after") != 0).alias("in"), (F.col("before") != 0).alias("entered"))
    order = Window.partitionBy(*KEYS, *([] if grid.ncol <= block else [F.floor(F.col("col_start") / block)])).orderBy("col_start")
    turns = levels.withColumn("was", F.coalesce(F.lag("in").over(order), "entered")).where("in <> was")
    runs = scanned(turns.drop("entered", "was"), None, "col_start", grid.ncol, block).where("in")
    runs = runs.select(*KEYS, "col_start", (F.col("next") - 1).alias("col_end"))
    return _from_one(runs), _from_one(runs.withColumn("share", F.lit(1.0)), "share", "part")

"""What reads a burn's tables: crop, expansion, lookup, aggregates and summaries."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.cells import center_x, center_y, col_of, inside, row_of
from meshwright.operators.burn import BurnResult
from meshwright.operators.polygons import TOLERANCE, merged_runs
from meshwright.plans.grid import Grid

_KIND_TABLES = {"polygon": ("runs", "edges"), "line": ("lines",), "point": ("points",)}


def _kinds_given(r: BurnResult) -> list[str]:
    """The geometry kinds of the input, by one job over these if they are known without a burn, else all kinds."""
    if r.kinds is None:
        return list(_KIND_TABLES)
    found = {k["kind"] for k in r.kinds.where(F.col("kind").isin(*_KIND_TABLES)).distinct().collect()}  # three at most
    return [k for k in _KIND_TABLES if k in found]


def kinds_present(r: BurnResult) -> list[str]:
    """The geometry kinds with any row. Polygons alone need one job over the kinds of the input; else the tables of the kinds there are get burnt."""
    kinds = _kinds_given(r)
    if r.kinds is not None and kinds == ["polygon"]:
        return kinds
    return [k for k in kinds if any(not getattr(r, n).isEmpty() for n in _KIND_TABLES[k])]


def check_single_kind(r: BurnResult, what: str) -> None:
    found = _kinds_given(r)
    found = kinds_present(r) if len(found) > 1 else found  # one kind needs no burn
    if len(found) > 1:
        raise ValueError(f"{what} of mixed geometry kinds ({', '.join(found)}) would add different units; take one kind first")


def crop(r: BurnResult, bounds: tuple[float, float, float, float]) -> BurnResult:
    """The part of a burn in a box (xmin, ymin, xmax, ymax), snapped outward to cells and counted from its first cell."""
    window = r.grid.window(*bounds)
    if window is None:
        warnings.warn("the target extent does not overlap the grid", stacklevel=2)
        return r.with_tables(**{n: t.limit(0) for n, t in (*r.tables().items(), ("cells", r.spans()))})
    row_lo, row_hi, col_lo, col_hi = window
    row = (F.col("row") - (row_lo - 1)).alias("row")
    rows = F.col("row").between(row_lo, row_hi)
    def clipped(t: DataFrame) -> DataFrame:
        ends = {"col_start": F.greatest("col_start", F.lit(col_lo)) - (col_lo - 1), "col_end": F.least("col_end", F.lit(col_hi)) - (col_lo - 1)}
        return t.where(rows & (F.col("col_end") >= col_lo) & (F.col("col_start") <= col_hi)).select(row, *(ends[c].alias(c) if c in ends else c for c in t.columns[1:]))

    cells = lambda t: t.where(rows & F.col("col").between(col_lo, col_hi)).select(row, (F.col("col") - (col_lo - 1)).alias("col"), *t.columns[2:])
    return r.with_tables(r.grid.sub(*window), runs=clipped(r.runs), edges=cells(r.edges), lines=cells(r.lines), points=cells(r.points), cells=clipped(r.spans()))


def table(r: BurnResult, name: str, expand: bool = False) -> DataFrame:
    """One table of a burn by its name, in the order of id, row and column; expand: runs as cells."""
    if name not in ("runs", "edges", "lines", "points", "notes"):
        raise ValueError("name must be runs, edges, lines, points or notes")
    found = expand_runs(r.runs) if name == "runs" and expand else getattr(r, name)
    return found.orderBy(*(c for c in ("id", "row", "col_start", "col") if c in found.columns))


def expand_runs(runs: DataFrame) -> DataFrame:
    """One row (row, col, id) for each cell of each run."""
    return runs.select("row", F.explode(F.sequence("col_start", "col_end")).alias("col"), "id")


def to_coo(r: BurnResult, kind: str = "polygon") -> DataFrame:
    """0-based row, col and val: coverage of polygons, length of lines, one for each point."""
    if kind not in _KIND_TABLES:
        raise ValueError("kind must be 'polygon', 'line' or 'point'")
    zero = lambda t, v: t.select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), v.alias("val"))
    if kind == "polygon":
        return zero(expand_runs(r.runs), F.lit(1.0)).unionByName(zero(r.edges, F.col("fraction")))
    return zero(r.lines, F.col("length")) if kind == "line" else zero(r.points, F.lit(1.0))


def pieces(r: BurnResult) -> DataFrame:
    """rank, row, col_start, col_end, id, part, measure of all tables in write order (rank: runs, edges, lines, points); each burn table is read once."""
    share = F.when(F.col("share") == 1, 0).otherwise(1)
    out = r.spans().select(share.alias("rank"), "row", "col_start", "col_end", "id", "part", F.col("share").alias("measure"))
    for k, (t, m) in enumerate(((r.lines, F.col("length")), (r.points, F.lit(1.0))), 2):
        out = out.unionByName(t.select(F.lit(k).alias("rank"), "row", F.col("col").alias("col_start"), F.col("col").alias("col_end"), "id", F.lit(0).alias("part"), m.cast("double").alias("measure")))
    return out


def measures(r: BurnResult) -> DataFrame:
    """rank, row, col, id, measure: :func:`pieces` with one row for each cell."""
    each = pieces(r).select("rank", "row", F.explode(F.sequence("col_start", "col_end")).alias("col"), "id", "measure")
    return each.select("rank", "row", F.col("col").cast("int").alias("col"), "id", "measure")


def in_blocks(spans: DataFrame, width: int) -> DataFrame:
    """Spans cut where a block of ``width`` columns ends, with the 0-based block: what has to meet by place is then joined or grouped by (row, block), so a row of very many spans is many keys."""
    at = lambda c: F.floor((F.col(c) - 1) / width).cast("int")
    one = at("col_start") == at("col_end")
    cut = spans.withColumn("block", F.explode(F.when(one, F.array(at("col_start"))).otherwise(F.sequence(at("col_start"), at("col_end")))))
    return cut.withColumns({"col_start": F.greatest("col_start", F.col("block") * width + 1), "col_end": F.least("col_end", (F.col("block") + 1) * width)})


def hits(r: BurnResult, queries: DataFrame, width: int = 1024) -> DataFrame:
    """qi, rank, id, measure of all entries at the cells of query points (qi, x, y) inside the extent.

    Entries are joined by row and block of columns, and the interval test is what remains.
    """
    x, y = F.col("x"), F.col("y")
    q = queries.where(inside(r.grid, x, y)).select("qi", row_of(r.grid, y).alias("row"), col_of(r.grid, x).alias("col"))
    q = q.withColumn("block", F.floor((F.col("col") - 1) / width).cast("int"))
    found = q.join(in_blocks(pieces(r), width), ["row", "block"]).where("col BETWEEN col_start AND col_end")
    return found.select("qi", "rank", "id", "measure")


def extract(r: BurnResult, queries: DataFrame, fun: str = "id", check: bool = True) -> DataFrame:
    """qi and value of every query point (qi, x, y): null outside the extent, else the id written last (null if none) or the sum of measures (0 if none).

    Entries are reduced before points look them up: runs of one value for each place, then one value for each cell that any
    point asks for. So a cell of very many points and entries is never made into their pairs.
    """
    if fun not in ("id", "sum"):
        raise ValueError("fun must be 'id' or 'sum'")
    if fun == "sum" and check:
        check_single_kind(r, "the sum")
    width = 256
    x, y = F.col("x"), F.col("y")
    within = inside(r.grid, x, y)
    at = queries.select("qi", within.alias("inside"), F.when(within, row_of(r.grid, y)).alias("row"), F.when(within, col_of(r.grid, x)).alias("col"))
    asked = at.where("inside").select("row", "col").distinct().withColumn("block", F.floor((F.col("col") - 1) / width).cast("int"))
    runs = last_ids(pieces(r), width) if fun == "id" else measure_sums(pieces(r), width)
    found = asked.join(runs, ["row", "block"]).where("col BETWEEN col_start AND col_end").select("row", "col", F.col("last" if fun == "id" else "total").cast("double").alias("found"))
    none = F.lit(None).cast("double") if fun == "id" else F.lit(0.0)
    return at.join(found, ["row", "col"], "left").select("qi", F.when(F.col("inside"), F.coalesce("found", none)).alias("value"))


def covered_area(r: BurnResult, by_id: bool = False) -> DataFrame:
    """covered_area, in all or for each id, from runs and edges."""
    many = (F.col("col_end") - F.col("col_start") + 1).cast("double")
    both = r.spans().select("id", (many * F.col("share")).alias("cells"))
    total = (F.lit(r.grid.cell_area) * F.coalesce(F.sum("cells"), F.lit(0.0))).alias("covered_area")
    return both.groupBy("id").agg(total) if by_id else both.agg(total)


def line_length(r: BurnResult, by_id: bool = False) -> DataFrame:
    """length of all lines, in all or for each id."""
    total = F.coalesce(F.sum("length"), F.lit(0.0)).alias("length")
    return r.lines.groupBy("id").agg(total) if by_id else r.lines.agg(total)


def point_counts(r: BurnResult) -> DataFrame:
    """row, col, n: how many points each cell has."""
    return r.points.groupBy("row", "col").agg(F.count("*").alias("n"))


def elementary(spans: DataFrame, width: int = 4096) -> DataFrame:
    """Spans (row, col_start, col_end, further columns) cut at every end of any span of their row, so that two of the results are equal in place or apart.

    A row's ends are gathered by block of ``width`` columns, so no more than width + 1 of them are held together. How many
    rows come out depends on how many spans overlap, not on how long they are. Adds block; a span is also cut where a block
    ends. Spans are exchanged by (row, block) once, and what groups or orders the result by these needs no other exchange.
    """
    cut = in_blocks(spans, width).withColumn("past", F.col("col_end") + 1).drop("col_end")
    place = Window.partitionBy("row", "block")
    both = cut.withColumns({"starts": F.collect_set("col_start").over(place), "pasts": F.collect_set("past").over(place)})
    rest = [c for c in cut.columns if c not in ("col_start", "past")]
    ends = F.filter(F.array_union("starts", "pasts"), lambda e: (e >= F.col("col_start")) & (e <= F.col("past")))
    own = both.select(*rest, F.explode(F.array(F.sort_array(ends))).alias("ends"))  # sorted once a span
    out = own.select(*rest, F.explode(F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends") - 1).alias("b"))).alias("s"))
    return out.select(*rest, F.col("s.a").alias("col_start"), (F.col("s.b") - 1).alias("col_end"))


def reduced(entries: DataFrame, how: dict[str, Callable[[str], Column]], width: int = 4096) -> DataFrame:
    """row, block, col_start, col_end and columns of entries reduced over all that lie at each place, by functions that can be taken in steps (sums, least and greatest values).

    Entries of one place are reduced in each task before any exchange, so a row of very many geometries comes down to the
    places that differ, width * (width + 1) / 2 of a block at most.
    """
    steps = [f(c).alias(c) for c, f in how.items()]
    places = in_blocks(entries, width).groupBy("row", "col_start", "col_end").agg(*steps)
    return elementary(places, width).groupBy("row", "block", "col_start", "col_end").agg(*steps)


def last_ids(entries: DataFrame, width: int = 4096) -> DataFrame:
    """row, block, col_start, col_end, last: the id written last at each place, of entries as :func:`pieces` has them."""
    ranks = range(4)
    each = entries.select("row", "col_start", "col_end", *(F.when(F.col("rank") == k, F.col("id")).alias(f"last_{k}") for k in ranks))
    found = reduced(each, {f"last_{k}": F.max for k in ranks}, width)
    return found.select("row", "block", "col_start", "col_end", F.coalesce(*(f"last_{k}" for k in reversed(ranks))).alias("last"))


def measure_sums(entries: DataFrame, width: int = 4096) -> DataFrame:
    """row, block, col_start, col_end, n, total: how many entries lie at each place, and the sum of their measures."""
    each = entries.select("row", "col_start", "col_end", F.lit(1).cast("long").alias("n"), F.col("measure").alias("total"))
    return reduced(each, {"n": F.sum, "total": F.sum}, width)


def largest_share(r: BurnResult, width: int = 4096) -> DataFrame:
    """row, col_start, col_end, id, share: the polygon with the largest share of each cell that any touches, as runs; shares of a geometry's parts are added, and the smaller id wins a tie (shares that are equal to nine places)."""
    cut = elementary(r.spans().drop("part"), width)
    of = cut.groupBy("row", "block", "col_start", "col_end", "id").agg(F.round(F.sum("share"), 9).alias("share"))
    best = of.groupBy("row", "block", "col_start", "col_end").agg(F.max("share").alias("share"), F.min_by("id", F.struct(-F.col("share"), F.col("id"))).alias("id"))
    return value_runs(best, ["id", "share"])


def value_runs(pieces: DataFrame, values: list[str]) -> DataFrame:
    """row, col_start, col_end and values of disjoint pieces (row, block, col_start, col_end, values): neighbours of equal values in one block become one run."""
    order = Window.partitionBy("row", "block").orderBy("col_start")
    same = (F.lag("col_end").over(order) + 1).eqNullSafe(F.col("col_start"))
    for v in values:
        same = same & F.lag(v).over(order).eqNullSafe(F.col(v))
    rows = pieces.select("row", "block", "col_start", *values, same.alias("same"), F.lag("col_end").over(order).alias("left"), F.max("col_end").over(Window.partitionBy("row", "block")).alias("end"))
    starts = rows.where("NOT same")
    return starts.select("row", "col_start", F.coalesce(F.lead("left").over(order), F.col("end")).alias("col_end"), *values)


def coverage_runs(r: BurnResult, width: int = 4096) -> DataFrame:
    """row, col_start, col_end, coverage: the sum of shares of all polygons, as runs of equal sums."""
    sums = elementary(r.spans().select("row", "col_start", "col_end", "share"), width).groupBy("row", "block", "col_start", "col_end").agg(F.sum("share").alias("coverage"))
    return value_runs(sums, ["coverage"])


def coverage_sums(r: BurnResult) -> DataFrame:
    """row, col, coverage: the sum of shares of all polygons in each cell; 1 where they tile the plane."""
    return by_cell(coverage_runs(r), "coverage")


def by_cell(runs: DataFrame, *values: str) -> DataFrame:
    """row, col and values: one row for each cell of runs."""
    each = runs.select("row", F.explode(F.sequence("col_start", "col_end")).alias("col"), *values)
    return each.withColumn("col", F.col("col").cast("int"))


def ids(r: BurnResult) -> DataFrame:
    """The distinct ids in any table."""
    return pieces(r).select("id").distinct()


def summary(r: BurnResult) -> DataFrame:
    """One row: counts of the tables, interior cells, ids, and the share of cells that nothing touches (overlaps count twice)."""
    p, many = pieces(r), (F.col("col_end") - F.col("col_start") + 1).cast("long")
    cells = [F.coalesce(F.sum(F.when(F.col("rank") == k, many)), F.lit(0)).alias(n) for k, n in enumerate(("interior", "edges", "lines", "points"))]
    out = r.runs.agg(F.count("*").alias("runs")).crossJoin(p.agg(*cells, F.countDistinct("id").alias("geometries")))  # single rows
    touched = F.col("interior") + F.col("edges") + F.col("lines") + F.col("points")
    return out.withColumn("sparsity", 1 - touched / F.lit(float(r.grid.nrow) * float(r.grid.ncol)))


def describe(r: BurnResult) -> str:
    """The summary as text; this is a job."""
    s, (nrow, ncol) = summary(r).first(), r.shape
    lines = [f"{ncol} x {nrow} grid, {s['geometries']} geometries", f"  runs:   {s['runs']} ({s['interior']} interior cells)", f"  edges:  {s['edges']} boundary cells"]
    lines += [f"  {n + ':':7} {s[n]} cells" for n in ("lines", "points") if s[n]]
    return "\n".join([*lines, f"  {100 * s['sparsity']:.1f}% of cells are empty"])


def cell_centers(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds x, y of the centres to cells (row, col)."""
    return cells.withColumns({"x": center_x(grid, F.col("col")), "y": center_y(grid, F.col("row"))})


def cumulative(raster: DataFrame, ncol: int, width: int = 256) -> DataFrame:
    """row, block, base, entries of a raster (row, col, value): what its running sum is up to a column, in blocks of ``width`` columns.

    An entry (at, total, n, odd) holds the sum of finite values, the number of values and that of NaN and infinite ones from
    a block's start to its column number ``at``; base (total, n, odd) is what is left of the block. From a row's first block on
    there are all blocks, so a lookup is an equality join.
    """
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    sums = {"total": F.sum(F.when(finite, F.col("value").cast("double")).otherwise(0.0)), "n": F.count("*"), "odd": F.count(F.when(~finite, True))}
    cells = raster.where("value IS NOT NULL").groupBy("row", "col").agg(*(v.alias(c) for c, v in sums.items()))
    cells = cells.withColumn("block", F.floor((F.col("col") - 1) / width).cast("int"))
    order = Window.partitionBy("row", "block").orderBy("col")
    entry = F.struct((F.col("col") - F.col("block") * width).cast("int").alias("at"), *(F.sum(c).over(order).alias(c) for c in sums))
    blocks = cells.select("row", "block", entry.alias("e")).groupBy("row", "block").agg(F.sort_array(F.collect_list("e")).alias("entries"))
    along = Window.partitionBy("row").orderBy("block")
    last = F.element_at("entries", -1)
    upto = F.struct(*(F.sum(last[c]).over(along).alias(c) for c in sums))
    left = F.struct(*(F.coalesce(F.sum(last[c]).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double" if c == "total" else "long")).alias(c) for c in sums))
    blocks = blocks.select("row", "block", "entries", upto.alias("upto"), left.alias("left"), F.coalesce(F.lead("block").over(along), F.lit(-(-ncol // width))).alias("until"))
    every = blocks.withColumn("b", F.explode(F.sequence("block", F.greatest(F.col("until") - 1, F.col("block")))))
    own = F.col("b") == F.col("block")
    return every.select("row", F.col("b").alias("block"), F.when(own, F.col("left")).otherwise(F.col("upto")).alias("base"), F.when(own, F.col("entries")).otherwise(F.slice("entries", 1, 0)).alias("entries"))


def zonal(r: BurnResult, raster: DataFrame, weights: bool = True, width: int = 256) -> DataFrame:
    """id, weight, total, mean of a raster (row, col, value) over each polygon, by coverage; weights=False takes boundary cells only.

    A span of cells takes the running sum at its end less that before its start: one row if both lie in one block of columns,
    else two, however long it is. A NaN or infinite value under a polygon makes its total NaN.
    """
    spans = r.spans() if weights else r.spans().where("share < 1")
    at = lambda c: F.floor((c - 1) / width).cast("int")
    hi, lo, none = F.col("col_end"), F.col("col_start") - 1, F.lit(None).cast("int")
    ask = lambda block, upto, left: F.struct(block.alias("block"), upto.alias("upto"), left.alias("left"))
    asks = F.when(at(hi) == at(lo), F.array(ask(at(hi), hi, lo))).otherwise(F.array(ask(at(hi), hi, none), ask(at(lo), none, lo)))
    asked = spans.select("row", "id", "share", F.explode(asks).alias("a")).select("row", "id", "share", "a.*")
    found = asked.join(cumulative(raster, r.grid.ncol, width), ["row", "block"])
    one = F.col("upto").isNotNull() & F.col("left").isNotNull()  # what is left of the block stands on both sides

    def running(upto: Column, c: str) -> Column:
        k = F.size(F.filter("entries", lambda e: e["at"] <= upto - F.col("block") * width))
        base = F.when(one, F.lit(0)).otherwise(F.col("base")[c])
        return F.when(upto.isNull(), F.lit(0)).when(k > 0, base + F.element_at("entries", k)[c]).otherwise(base)

    own = {c: running(F.col("upto"), c) - running(F.col("left"), c) for c in ("total", "n", "odd")}
    weight, total = F.sum(F.col("share") * own["n"]), F.when(F.sum(own["odd"]) > 0, F.lit(float("nan"))).otherwise(F.sum(F.col("share") * own["total"]))
    return found.groupBy("id").agg(weight.alias("weight"), total.alias("total")).where("weight > 1e-9").withColumn("mean", F.col("total") / F.col("weight"))


#: Columns of a group that spans are put together from, see :func:`overlay_runs`.
GROUP = 16


def _group(col: Column) -> Column:
    """A number below zero for the group of columns that a column lies in."""
    return -1 - F.floor((col - 1) / GROUP).cast("int")


def _starts(spans: DataFrame, k: int) -> DataFrame:
    """One row for each node that holds a span's first column: the column and its group."""
    first = F.col(f"a{k}")
    return spans.withColumn("node", F.explode(F.array(first, _group(first))))


def _covers(spans: DataFrame, k: int, skip: int = 0) -> DataFrame:
    """One row for each node that a span, without its first ``skip`` columns, is put together from: whole groups, and single columns before and behind them."""
    a, b = F.col(f"a{k}") + skip, F.col(f"b{k}")
    low, high = -F.floor((1 - a) / GROUP).cast("int"), F.floor(b / GROUP).cast("int")  # 0-based, high is not in
    nodes = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    whole = F.concat(nodes(a, low * GROUP), F.transform(nodes(low, high - 1), lambda g: -1 - g), nodes(high * GROUP + 1, b))
    return spans.withColumn("node", F.explode(F.when(low < high, whole).otherwise(nodes(a, b))))


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and ``ids``, an array of structs (id), of ``rows`` (keys, id): one row for those of one task that are equal in all keys, so an array is no longer than what a task reads."""
    return rows.withColumn("task", F.spark_partition_id()).groupBy(*keys, "task").agg(F.collect_list(F.struct("id")).alias("ids")).drop("task")


def _paired(rows: DataFrame, *rest: str) -> DataFrame:
    """``rest``, id_1 and id_2 of rows (ids_1, ids_2): one row for each two ids, made where they come out."""
    for k in (2, 1):
        rows = rows.withColumn(f"one_{k}", F.explode(f"ids_{k}"))
    return rows.select(*rest, *(F.col(f"one_{k}.id").alias(f"id_{k}") for k in (1, 2)))


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """row, col_start, col_end and what else the spans (row, a1, b1; row, a2, b2) of two sides have, of each two that share cells.

    Two spans share cells if one of them begins in the other. A span is put together from few columns and groups of columns, and
    a column lies in one of these at most, so spans meet by equality, each two once and none that share nothing: the
    work is that of the rows that come out.
    """
    rest = [c for side in (left, right) for c in side.columns[3:]]
    out = lambda both, first: both.select("row", F.col(first).alias("col_start"), F.least("b1", "b2").alias("col_end"), *rest)
    inner = out(_starts(left, 1).join(_covers(right, 2), ["row", "node"]), "a1")
    return inner.unionByName(out(_covers(left, 1, 1).join(_starts(right, 2), ["row", "node"]), "a2"))


def overlay_runs(one: BurnResult, two: BurnResult, width: int = 256) -> DataFrame:
    """row, col_start, col_end, id_1, id_2, measure_1, measure_2: the runs of cells that entries of two burns of one grid share. A run longer than a block of ``width`` columns comes in pieces."""
    side = lambda r, k: in_blocks(pieces(r), width).select("row", F.col("col_start").alias(f"a{k}"), F.col("col_end").alias(f"b{k}"), F.col("id").alias(f"id_{k}"), F.col("measure").alias(f"measure_{k}"))
    return _meeting(side(one, 1), side(two, 2)).select("row", "col_start", "col_end", "id_1", "id_2", "measure_1", "measure_2")


def overlay(one: BurnResult, two: BurnResult, width: int = 256) -> DataFrame:
    """row, col, id_1, id_2, measure_1, measure_2 of the cells that two burns of one grid share.

    Entries equal in place and measure meet as one row that holds their ids, so joins make far fewer rows than come out.
    """

    def side(r: BurnResult, k: int) -> DataFrame:
        rows = gathered(in_blocks(pieces(r), width).select("row", "col_start", "col_end", "measure", "id"), "row", "col_start", "col_end", "measure")
        return rows.select("row", F.col("col_start").alias(f"a{k}"), F.col("col_end").alias(f"b{k}"), F.col("ids").alias(f"ids_{k}"), F.col("measure").alias(f"measure_{k}"))

    cells = by_cell(_meeting(side(one, 1), side(two, 2)), "ids_1", "ids_2", "measure_1", "measure_2")
    return _paired(cells, "row", "col", "measure_1", "measure_2").select("row", "col", "id_1", "id_2", "measure_1", "measure_2")


def overlay_sums(one: BurnResult, two: BurnResult, width: int = 256) -> DataFrame:
    """row, col_start, col_end, n, total_1, total_2: how many rows :func:`overlay` has for each cell of a run, and the sums of their two measures. Each side is summed by place first, and no pair of entries is made."""
    side = lambda r, k: measure_sums(pieces(r), width).select("row", "block", F.col("col_start").alias(f"a{k}"), F.col("col_end").alias(f"b{k}"), F.col("n").alias(f"n{k}"), F.col("total").alias(f"t{k}"))
    both = side(one, 1).join(side(two, 2), ["row", "block"]).where("a1 <= b2 AND a2 <= b1")
    n = {"n": F.col("n1") * F.col("n2"), "total_1": F.col("t1") * F.col("n2"), "total_2": F.col("t2") * F.col("n1")}
    return both.select("row", F.greatest("a1", "a2").alias("col_start"), F.least("b1", "b2").alias("col_end"), *(v.alias(c) for c, v in n.items()))


def alike(r: BurnResult) -> DataFrame:
    """id, like: the least of the ids whose entries are the same (measures to 2^-40), told by two 64-bit hashes of each entry, added up."""
    entry = ("rank", "row", "col_start", "col_end", F.round(F.col("measure") * float(1 << 40)).alias("m"))
    hashed = pieces(r).select("id", *entry).select("id", F.xxhash64("rank", "row", "col_start", "col_end", "m").alias("h"), F.xxhash64("m", "col_end", "col_start", "row", "rank").alias("g"))
    halves = {f"{c}{k}": F.sum(F.shiftrightunsigned(c, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))) for c in "hg" for k in range(2)}  # sums that can't overflow
    signs = hashed.groupBy("id").agg(F.count("*").alias("n"), *(v.alias(c) for c, v in halves.items()))
    keys = ["n", *halves]
    return signs.join(signs.groupBy(*keys).agg(F.min("id").alias("like")), keys).select("id", "like")


def overlay_areas(one: BurnResult, two: BurnResult) -> DataFrame:
    """id_1, id_2, cells, weight: of each two polygons with cells in common, how many these are and the sum of the products of their shares. No row is made for a cell.

    Pairs are added up for one geometry of those that are alike, and the others' rows follow from these and the ids that are
    alike, which go along as arrays; so what is exchanged is not as many rows as come out, unless all geometries differ.
    """
    same = [alike(r) for r in (one, two)]
    few = [r.only(s.where("id = like")) for r, s in zip((one, two), same, strict=True)]
    many = (F.col("col_end") - F.col("col_start") + 1).cast("long")
    sums = overlay_runs(*few).groupBy("id_1", "id_2").agg(F.sum(many).alias("cells"), F.sum(many * F.col("measure_1") * F.col("measure_2")).alias("weight"))
    for k in (2, 1):
        sums = sums.join(gathered(same[k - 1], "like").select(F.col("like").alias(f"id_{k}"), F.col("ids").alias(f"ids_{k}")), f"id_{k}").drop(f"id_{k}")
    return _paired(sums, "cells", "weight").select("id_1", "id_2", "cells", "weight")


def moved(r: BurnResult, grid: Grid) -> BurnResult:
    """A burn on another aligned grid of the same cell size: entries move by whole rows and columns, and what lies beyond the grid is cut off."""
    down, right = _offsets(r.grid, grid)
    row = (F.col("row") - down).cast("int").alias("row")
    rows = (F.col("row") - down).between(1, grid.nrow)

    def runs(t: DataFrame) -> DataFrame:
        a, b = F.greatest(F.col("col_start") - right, F.lit(1)).cast("int"), F.least(F.col("col_end") - right, F.lit(grid.ncol)).cast("int")
        return t.where(rows & (a <= b)).select(row, a.alias("col_start"), b.alias("col_end"), *t.columns[3:])

    col = F.col("col") - right
    cells = lambda t: t.where(rows & col.between(1, grid.ncol)).select(row, col.cast("int").alias("col"), *t.columns[2:])
    return r.with_tables(grid, runs=runs(r.runs), edges=cells(r.edges), lines=cells(r.lines), points=cells(r.points), cells=runs(r.spans()))


def _offsets(one: Grid, two: Grid) -> tuple[int, int]:
    if not one.compatible_with(two):
        raise ValueError("the grids don't line up")
    return one.offsets(two)


def coarsened(r: BurnResult, factor: int, width: int = 4096) -> BurnResult:
    """A coverage burn on a grid of cells ``factor`` times as wide and high, whose rows and columns the factor must divide; shares are averaged and lengths added.

    A long run is one run of coarse cells and two ends, so this costs the boundary and the rows.
    """
    g = r.grid
    if factor < 1 or g.nrow % factor or g.ncol % factor:
        raise ValueError("the factor must divide the grid's rows and columns")
    grid = Grid(*g.bounds, g.ncol // factor, g.nrow // factor)
    up = lambda c: (F.floor((F.col(c) - 1) / factor) + 1).cast("int")
    wide = r.spans().select(up("row").alias("row"), "col_start", "col_end", "share", "part", "id")
    a, b = up("col_start"), up("col_end")
    part = lambda lo, hi, n: F.struct(lo.cast("int").alias("col_start"), hi.cast("int").alias("col_end"), (F.col("share") * n / float(factor * factor)).alias("share"))
    first = F.least(F.col("col_end"), a * factor) - F.col("col_start") + 1
    last = F.col("col_end") - (b - 1) * factor
    ends = F.when(a == b, F.array(part(a, a, F.col("col_end") - F.col("col_start") + 1))).otherwise(F.array(part(a, a, first), part(a + 1, b - 1, F.lit(factor)), part(b, b, last)))
    spans = wide.select("row", "part", "id", F.explode(ends).alias("s")).select("row", "part", "id", "s.*").where("col_start <= col_end")
    cut = elementary(spans, width).groupBy("id", "part", "row", "block", "col_start", "col_end").agg(F.sum("share").alias("share"))
    whole = F.when(F.col("share") >= 1 - TOLERANCE, F.lit(1.0)).otherwise(F.col("share"))
    cells = cut.select("row", "col_start", "col_end", whole.alias("share"), "part", "id")
    zero = cells.where("share = 1").select("id", "part", (F.col("row") - 1).alias("row"), (F.col("col_start") - 1).alias("col_start"), (F.col("col_end") - 1).alias("col_end"))
    edges = by_cell(cells.where("share < 1"), "share", "id").select("row", "col", F.col("share").alias("fraction"), "id")
    lines = r.lines.groupBy(up("row").alias("row"), up("col").alias("col"), "id").agg(F.sum("length").alias("length")).select("row", "col", "length", "id")
    points = r.points.select(up("row").alias("row"), up("col").alias("col"), "id")
    return r.with_tables(grid, runs=merged_runs(zero, grid.ncol), edges=edges, lines=lines, points=points, cells=cells)


def raster_values(raster: DataFrame, expression: Column) -> DataFrame:
    """A raster with another value for each cell."""
    return raster.withColumn("value", expression)

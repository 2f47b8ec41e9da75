"""The registered queries and, for each, SQL that finds the same rows in another way: overlaps of intervals for coverage, tests of every cell's centre, clipping of each step to each cell."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.cells import box
from meshwright.operators import dense, results, stored
from meshwright.operators.burn import BurnResult, burn, burn_segments
from meshwright.plans import synth
from meshwright.plans.grid import Grid, extent_of

G = synth.GRID
CROP = (10.0, 11.0, 31.0, 40.5)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL in common: rows and columns of the grid, and the share of each cell that each part covers -------------------
_LINES = "rr AS (SELECT CAST(i AS INT) AS row, 60 - (i - 0.5e0) * 2 AS ym, 60 - i * 2e0 AS yl, 60 - (i - 1) * 2e0 AS yh FROM range(1, 31) AS t(i)), cc AS (SELECT CAST(i AS INT) AS col, (i - 0.5e0) * 1.5e0 AS xm, (i - 1) * 1.5e0 AS xl, i * 1.5e0 AS xh FROM range(1, 41) AS t(i))"
_RECT = f"WITH rect AS ({synth.RECTANGLES}), {_LINES}"
_COVER = f"""{_RECT}, cov AS (SELECT id, part, row, col, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * (least(bx, xh) - greatest(ax, xl)) * (least(bz, yh) - greatest(ay, yl))) / 3e0 AS f
FROM rect JOIN cc ON xl < bx AND xh > ax JOIN rr ON yl < bz AND yh > ay GROUP BY id, part, row, col),
meas AS (SELECT id, part, row, col, CASE WHEN f >= 0.999999 THEN 0 ELSE 1 END AS rank, CASE WHEN f >= 0.999999 THEN 1e0 ELSE f END AS m FROM cov WHERE f > 0.000001)"""
_APPROX = f"""{_RECT}, hit AS (SELECT id, part, row, col FROM rect JOIN cc ON xm >= ax AND xm < bx JOIN rr ON ym > ay AND ym <= bz GROUP BY id, part, row, col HAVING sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END) > 0)"""
_RUNS = "SELECT id, part, row, min(col) AS col_start, max(col) AS col_end FROM (SELECT id, part, row, col, col - row_number() OVER (PARTITION BY id, part, row ORDER BY col) AS k FROM {}) AS q GROUP BY id, part, row, k"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def settled(column: str, places: int) -> Column:
    """A number cut to some places, at a point where sums of eighths have no ties, so that noise in the last bits doesn't show."""
    return F.floor(F.col(column) * F.lit(float(10**places)) + 0.26) / F.lit(float(10**places))


def rect_burn(spark: SparkSession, sf_dir: str, mode: str = "coverage") -> BurnResult:
    return burn_segments(synth.rectangles(spark, sf_dir), None, G, mode, combine=False, kind="polygon")  # four vertices a ring


def line_burn(spark: SparkSession, sf_dir: str) -> BurnResult:
    return burn_segments(synth.tracks(spark, sf_dir), None, G, kind="line")


def point_burn(spark: SparkSession, sf_dir: str) -> BurnResult:
    points = synth.event_points(spark, sf_dir)
    return burn_segments(points.select("id"), points, G, kind="point")


_CELL = "CAST(least(floor((60 - y) / 2e0), 29) + 1 AS INT) AS row, CAST(least(floor(x / 1.5e0), 39) + 1 AS INT) AS col"


@query("points_burn", f"SELECT {_CELL}, id FROM ({synth.POINTS}) AS p WHERE x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60")
def _(spark, d):  # noqa: ANN001, ANN202
    return point_burn(spark, d).points


@query("points_count", f"SELECT row, col, count(*) AS n FROM (SELECT {_CELL} FROM ({synth.POINTS}) AS p WHERE x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60) AS q GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.point_counts(point_burn(spark, d))


_CLIP = f"""WITH st AS ({synth.STEPS}), {_LINES}, tt AS (SELECT id, row, col, x0, y0, x1, y1,
CASE WHEN x1 = x0 THEN 0e0 ELSE least((xl - x0) / (x1 - x0), (xh - x0) / (x1 - x0)) END AS ta, CASE WHEN x1 = x0 THEN 1e0 ELSE greatest((xl - x0) / (x1 - x0), (xh - x0) / (x1 - x0)) END AS tb,
CASE WHEN y1 = y0 THEN 0e0 ELSE least((yl - y0) / (y1 - y0), (yh - y0) / (y1 - y0)) END AS sa, CASE WHEN y1 = y0 THEN 1e0 ELSE greatest((yl - y0) / (y1 - y0), (yh - y0) / (y1 - y0)) END AS sb
FROM st JOIN cc ON xl < greatest(x0, x1) + 0.001 AND xh > least(x0, x1) - 0.001 JOIN rr ON yl < greatest(y0, y1) + 0.001 AND yh > least(y0, y1) - 0.001),
piece AS (SELECT id, row, col, sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * (least(tb, sb, 1e0) - greatest(ta, sa, 0e0))) AS length FROM tt WHERE greatest(ta, sa, 0e0) < least(tb, sb, 1e0) GROUP BY id, row, col)"""


@query("lines_burn", f"{_CLIP} SELECT row, col, id, round(length, 6) AS length FROM piece WHERE length > 0.000001")
def _(spark, d):  # noqa: ANN001, ANN202
    return line_burn(spark, d).lines.where("length > 0.000001").withColumn("length", F.round("length", 6))


@query("line_length_total", f"SELECT id, round(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))), 5) AS length FROM ({synth.STEPS}) AS s GROUP BY id HAVING sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) > 0")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.line_length(line_burn(spark, d), by_id=True).withColumn("length", F.round("length", 5))


@query("poly_coverage_edges", f"{_COVER} SELECT row, col, id, floor((m) * 1e6 + 0.26) / 1e6 AS fraction FROM meas WHERE rank = 1")
def _(spark, d):  # noqa: ANN001, ANN202
    return rect_burn(spark, d).edges.withColumn("fraction", settled("fraction", 6))


@query("poly_coverage_runs", f"{_COVER} SELECT row, CAST(col_start AS INT) AS col_start, CAST(col_end AS INT) AS col_end, id FROM ({_RUNS.format('meas WHERE rank = 0')}) AS r")
def _(spark, d):  # noqa: ANN001, ANN202
    return rect_burn(spark, d).runs


@query("expand_runs", f"{_COVER} SELECT row, col, id FROM meas WHERE rank = 0")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.expand_runs(rect_burn(spark, d).runs)


@query("poly_approx_runs", f"{_APPROX} SELECT row, CAST(col_start AS INT) AS col_start, CAST(col_end AS INT) AS col_end, id FROM ({_RUNS.format('hit')}) AS r")
def _(spark, d):  # noqa: ANN001, ANN202
    return rect_burn(spark, d, "approx").runs


@query("poly_approx_cells", f"{_APPROX} SELECT row, col, id FROM hit")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.expand_runs(rect_burn(spark, d, "approx").runs)


_SIDES = f"""WITH tri AS ({synth.TRIANGLES}), {_LINES}, seg AS (SELECT id, ax AS x0, ay AS y0, bx AS x1, bz AS y1 FROM tri UNION ALL SELECT id, bx, bz, cx, cy FROM tri UNION ALL SELECT id, cx, cy, ax, ay FROM tri)"""


@query("tri_approx_cells", f"""{_SIDES} SELECT row, col, id FROM seg JOIN rr ON least(y0, y1) < ym AND ym <= greatest(y0, y1) JOIN cc ON x0 + (ym - y0) / (y1 - y0) * (x1 - x0) <= xm
WHERE y0 <> y1 GROUP BY id, row, col HAVING sum(CASE WHEN y0 >= ym THEN -1 ELSE 1 END) <> 0""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    return results.expand_runs(burn_segments(synth.triangles(spark, d), None, G, "approx").runs)


def _below(t: str) -> str:
    """SQL: the area of a triangle (area a, corners' y sorted as p, q, r) below the height t."""
    low = f"a * ({t} - p) * ({t} - p) / ((q - p) * (r - p))"
    high = f"a - a * (r - {t}) * (r - {t}) / ((r - q) * (r - p))"
    return f"CASE WHEN {t} <= p THEN 0e0 WHEN {t} >= r THEN a WHEN {t} <= q THEN {low} ELSE {high} END"


@query("tri_covered_area", f"""WITH t AS (SELECT id, abs((bx - ax) * (cy - ay) - (cx - ax) * (bz - ay)) / 2 AS a, least(ay, bz, cy) AS p, ay + bz + cy - least(ay, bz, cy) - greatest(ay, bz, cy) AS q, greatest(ay, bz, cy) AS r FROM ({synth.TRIANGLES}) AS s)
SELECT id, CAST(floor((({_below('60e0')}) - ({_below('0e0')})) * 100 + 0.26) AS BIGINT) AS hundredths FROM t WHERE a > 0""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    area = results.covered_area(burn_segments(synth.triangles(spark, d), None, G, combine=False), by_id=True)
    return area.select("id", F.floor(F.col("covered_area") * 100 + 0.26).alias("hundredths"))


@query("covered_area_by_id", f"{_COVER} SELECT id, floor((3e0 * sum(m)) * 1e5 + 0.26) / 1e5 AS covered_area FROM meas GROUP BY id")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.covered_area(rect_burn(spark, d), by_id=True).withColumn("covered_area", settled("covered_area", 5))


@query("bbox_extent", f"SELECT min(ax) AS xmin, min(ay) AS ymin, max(bx) AS xmax, max(bz) AS ymax FROM ({synth.RECTANGLES}) AS r")
def _(spark, d):  # noqa: ANN001, ANN202
    rows = synth.rectangles(spark, d)
    found = extent_of(rows.select(F.col("x0").alias("x"), F.col("y0").alias("y")))
    return spark.createDataFrame([found], "xmin double, ymin double, xmax double, ymax double")


@query("signed_area", f"SELECT id, ((bx - ax) * (cy - ay) - (cx - ax) * (bz - ay)) / 2 AS area FROM ({synth.TRIANGLES}) AS t")
def _(spark, d):  # noqa: ANN001, ANN202
    from meshwright.functions.rings import signed_area

    rows = synth.view(spark, d, synth.TRIANGLES, "supplier")
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "bz"), ("cx", "cy"), ("ax", "ay"))))
    return rows.select("id", signed_area(ring).alias("area"))


_VALUES = "vals AS (SELECT p_partkey AS vid, p_retailprice AS v FROM part)"
_WRITE = f"{_COVER}, {_VALUES}, wr AS (SELECT row, col, id, rank, v FROM meas JOIN vals ON vid = id WHERE rank = 0 OR m >= 0.503)"
_BY = {
    "first": "arg_min(v, rank * 1000000000 + id)", "last": "arg_max(v, rank * 1000000000 + id)", "sum": "round(sum(v), 4)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)", "any": "1e0",
}


def _values(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))


for _fn in dense.FUNCTIONS:

    @query(f"materialize_{_fn}", f"{_WRITE} SELECT row, col, {_BY[_fn]} AS value FROM wr GROUP BY row, col")
    def _(spark, d, fn=_fn):  # noqa: ANN001, ANN202
        out = dense.materialize(rect_burn(spark, d), _values(spark, d), fn, threshold=0.503, check=False)
        return out.withColumn("value", F.round("value", 4)) if fn == "sum" else out


@query("materialize_fraction", f"{_COVER}, {_VALUES} SELECT row, col, floor((sum(CASE WHEN rank = 0 THEN v ELSE v * m END)) * 1e3 + 0.26) / 1e3 AS value FROM meas JOIN vals ON vid = id GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize(rect_burn(spark, d), _values(spark, d), "sum", "fraction", check=False).withColumn("value", settled("value", 3))


@query("materialize_threshold", f"{_COVER} SELECT row, col, CAST(count(*) AS DOUBLE) + 10 AS value FROM meas WHERE rank = 0 OR m >= 0.76 GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize(rect_burn(spark, d), fn="count", threshold=0.76, background=10.0, check=False)


@query("materialize_id", f"{_COVER} SELECT row, col, CAST(arg_max(id, rank * 1000000000 + id) AS DOUBLE) AS value FROM meas GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize_chunk(rect_burn(spark, d), "id")


@query("materialize_all", f"{_COVER} SELECT row, col, floor((5 + sum(m)) * 1e6 + 0.26) / 1e6 AS value FROM meas GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize_all(rect_burn(spark, d), 5.0, allow_mixed=True).withColumn("value", settled("value", 6))


# the window of CROP: columns 7 to 21, rows 10 to 25
@query("crop_runs", f"{_COVER} SELECT row - 9 AS row, CAST(col_start - 6 AS INT) AS col_start, CAST(col_end - 6 AS INT) AS col_end, id FROM ({_RUNS.format('meas WHERE rank = 0 AND row BETWEEN 10 AND 25 AND col BETWEEN 7 AND 21')}) AS r")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.crop(rect_burn(spark, d), CROP).runs


@query("crop_edges", f"{_COVER} SELECT row - 9 AS row, col - 6 AS col, floor((m) * 1e6 + 0.26) / 1e6 AS fraction, id FROM meas WHERE rank = 1 AND row BETWEEN 10 AND 25 AND col BETWEEN 7 AND 21")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.crop(rect_burn(spark, d), CROP).edges.withColumn("fraction", settled("fraction", 6))


_ASK = f"ask AS (SELECT id AS qi, x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60 AS ok, {_CELL} FROM ({synth.POINTS}) AS p)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return synth.event_points(spark, d).withColumnRenamed("id", "qi")


@query("extract_id", f"{_COVER}, {_ASK} SELECT qi, CAST(arg_max(id, rank * 1000000000 + id) AS DOUBLE) AS value FROM ask LEFT JOIN meas ON ok AND ask.row = meas.row AND ask.col = meas.col GROUP BY qi")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.extract(rect_burn(spark, d), _asked(spark, d), "id")


@query("extract_sum", f"{_COVER}, {_ASK} SELECT qi, CASE WHEN bool_or(ok) THEN floor((coalesce(sum(m), 0e0)) * 1e6 + 0.26) / 1e6 END AS value FROM ask LEFT JOIN meas ON ok AND ask.row = meas.row AND ask.col = meas.col GROUP BY qi")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.extract(rect_burn(spark, d), _asked(spark, d), "sum", check=False).withColumn("value", settled("value", 6))


@query("to_coo", f"{_COVER} SELECT row - 1 AS row, col - 1 AS col, floor((m) * 1e6 + 0.26) / 1e6 AS val FROM meas")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.to_coo(rect_burn(spark, d)).withColumn("val", settled("val", 6))


@query("summary", f"""{_COVER}, n AS (SELECT count(*) AS runs FROM ({_RUNS.format('meas WHERE rank = 0')}) AS r), k AS (SELECT sum(CASE WHEN rank = 0 THEN 1 ELSE 0 END) AS interior, sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS edges, count(DISTINCT id) AS geometries, count(*) AS touched FROM meas)
SELECT runs, CAST(interior AS BIGINT) AS interior, CAST(edges AS BIGINT) AS edges, CAST(0 AS BIGINT) AS lines, CAST(0 AS BIGINT) AS points, geometries, round(1 - touched / 1200e0, 9) AS sparsity FROM n, k""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    return results.summary(rect_burn(spark, d)).withColumn("sparsity", F.round("sparsity", 9))


@query("zonal_weighted_mean", f"{_COVER}, ras AS ({synth.RASTER}) SELECT id, floor((sum(m)) * 1e5 + 0.26) / 1e5 AS weight, floor(sum(m * value) / sum(m) * 1e3 + 0.26) / 1e3 AS mean FROM meas JOIN ras ON ras.row = meas.row AND ras.col = meas.col GROUP BY id")
def _(spark, d):  # noqa: ANN001, ANN202
    out = results.zonal(rect_burn(spark, d), synth.raster(spark, d))
    return out.select("id", settled("weight", 5).alias("weight"), settled("mean", 3).alias("mean"))


@query("overlay_cells", f"""{_COVER}, pc AS (SELECT {_CELL}, id AS id_2 FROM ({synth.POINTS}) AS p WHERE x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60)
SELECT meas.row, meas.col, count(*) AS n, floor((sum(m)) * 1e5 + 0.26) / 1e5 AS weight FROM meas JOIN pc ON pc.row = meas.row AND pc.col = meas.col GROUP BY meas.row, meas.col""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    both = results.by_cell(results.overlay_sums(rect_burn(spark, d), point_burn(spark, d)), "n", "total_1")
    return both.withColumnRenamed("total_1", "weight").withColumn("weight", settled("weight", 5))


@query("complementarity", f"{_COVER} SELECT row, col, floor((sum(m)) * 1e6 + 0.26) / 1e6 AS coverage FROM meas GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.coverage_sums(rect_burn(spark, d)).withColumn("coverage", settled("coverage", 6))


@query("tile_index", f"{_COVER} SELECT CAST(floor((row - 1) / 7e0) AS INT) AS tile_row, CAST(floor((col - 1) / 7e0) AS INT) AS tile_col, count(*) AS cells FROM meas GROUP BY 1, 2")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.tile_index(rect_burn(spark, d), 7)


@query("cell_centers", f"WITH {_LINES} SELECT row, col, xm AS x, ym AS y FROM rr, cc")
def _(spark, d):  # noqa: ANN001, ANN202
    cells = spark.range(1, 31).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("col"))
    return results.cell_centers(cells, G)


@query("cell_boxes", f"WITH {_LINES} SELECT row, col, xl AS xmin, yl AS ymin, xh AS xmax, yh AS ymax FROM rr, cc")
def _(spark, d):  # noqa: ANN001, ANN202
    cells = spark.range(1, 31).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("col"))
    return cells.withColumn("b", box(G, F.col("row"), F.col("col"))).select("row", "col", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query("ids_distinct", f"{_COVER} SELECT DISTINCT id FROM meas")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.ids(rect_burn(spark, d))


@query("raster_runs", f"""WITH ras AS (SELECT row, col, CAST(floor(value / 4000) AS BIGINT) AS id FROM ({synth.RASTER}) AS q)
SELECT row, min(col) AS col_start, max(col) AS col_end, id FROM (SELECT row, col, id, col - row_number() OVER (PARTITION BY row, id ORDER BY col) AS k FROM ras) AS t GROUP BY row, id, k""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.from_dense(results.raster_values(synth.raster(spark, d), F.floor(F.col("value") / 4000)))


def _wkb(x0: float, y0: float, x1: float, y1: float) -> bytes:
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return struct.pack("<BII I", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in ring)


def _mixed(spark: SparkSession) -> BurnResult:
    rows = [(1, b"\x01\x03\x00"), (2, _wkb(2.5, 4.5, 6.5, 8.5)), (3, None), (4, struct.pack("<BII", 1, 7, 0)), (5, struct.pack("<BIdd", 1, 1, 9.5, 0.5)), (6, struct.pack("<BII4d", 1, 2, 2, 0.5, 0.5, 2.5, 0.5))]
    return burn(spark.createDataFrame(rows, "id int, wkb binary"), grid=Grid(0, 0, 10, 10, 10, 10), keep=False)


@query("wkb_burn", """SELECT * FROM (VALUES (3, 3, 0, 0.25e0, 2)) AS t(row, col, rank, measure, id) WHERE false
UNION ALL SELECT CAST(r AS INT), CAST(c AS INT), CAST(CASE WHEN r IN (2, 6) OR c IN (3, 7) THEN 1 ELSE 0 END AS INT), CASE WHEN r IN (2, 6) THEN 0.5e0 ELSE 1e0 END * CASE WHEN c IN (3, 7) THEN 0.5e0 ELSE 1e0 END, 2 FROM range(2, 7) AS a(r), range(3, 8) AS b(c)
UNION ALL SELECT 10, CAST(c AS INT), 2, CASE WHEN c = 2 THEN 1e0 ELSE 0.5e0 END, 6 FROM range(1, 4) AS b(c) UNION ALL SELECT 10, 10, 3, 1e0, 5""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    return results.measures(_mixed(spark)).withColumn("measure", F.round("measure", 9))


@query("notes", "SELECT 1 AS id, 'WKB too short' AS message UNION ALL SELECT 4, 'GeometryCollection is not supported: its members measure different things; split it by kind'")
def _(spark, d):  # noqa: ANN001, ANN202
    return _mixed(spark).notes


# ---- backgrounds, sums and coordinate lists of lines and points, geometry beyond all sides of the grid, forms of WKB ----
_OVER = {"first": "300e0", "last": _BY["last"], "min": "least(300e0, min(v))", "max": "greatest(300e0, max(v))", "any": "1e0"}

for _fn, _sql in _OVER.items():

    @query(f"background_{_fn}", f"{_WRITE} SELECT row, col, {_sql} AS value FROM wr GROUP BY row, col")
    def _(spark, d, fn=_fn):  # noqa: ANN001, ANN202
        return dense.materialize(rect_burn(spark, d), _values(spark, d), fn, threshold=0.503, background=300.0)


@query("chunk_sum_lines", f"{_CLIP} SELECT row, col, round(sum(length), 5) AS value FROM piece WHERE length > 0.000001 GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    long = line_burn(spark, d)
    long = long.with_tables(lines=long.lines.where("length > 0.000001"))
    return dense.materialize_chunk(long, "sum").withColumn("value", F.round("value", 5))


@query("chunk_sum_points", f"SELECT row, col, CAST(count(*) AS DOUBLE) AS value FROM (SELECT {_CELL} FROM ({synth.POINTS}) AS p WHERE x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60) AS q GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize_chunk(point_burn(spark, d), "sum", check=False)


@query("to_coo_lines", f"{_CLIP} SELECT row - 1 AS row, col - 1 AS col, round(length, 6) AS val FROM piece WHERE length > 0.000001")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.to_coo(line_burn(spark, d), "line").where("val > 0.000001").withColumn("val", F.round("val", 6))


@query("to_coo_points", f"SELECT row - 1 AS row, col - 1 AS col, 1e0 AS val FROM (SELECT {_CELL} FROM ({synth.POINTS}) AS p WHERE x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60) AS q")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.to_coo(point_burn(spark, d), "point")


#: The same cells, but only those of a window: geometry reaches beyond it on all sides.
SMALL = Grid(12.0, 10.0, 36.0, 42.0, 16, 16)
_SMALL = "rr AS (SELECT CAST(i AS INT) AS row, 42 - (i - 0.5e0) * 2 AS ym, 42 - i * 2e0 AS yl, 42 - (i - 1) * 2e0 AS yh FROM range(1, 17) AS t(i)), cc AS (SELECT CAST(i AS INT) AS col, 12 + (i - 0.5e0) * 1.5e0 AS xm, 12 + (i - 1) * 1.5e0 AS xl, 12 + i * 1.5e0 AS xh FROM range(1, 17) AS t(i))"


@query("beyond_coverage", f"{_COVER.replace(_LINES, _SMALL)} SELECT rank, row, col, id, floor((m) * 1e6 + 0.26) / 1e6 AS measure FROM meas")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.measures(burn_segments(synth.rectangles(spark, d), None, SMALL)).withColumn("measure", settled("measure", 6))


@query("beyond_approx", f"{_APPROX.replace(_LINES, _SMALL)} SELECT row, CAST(col_start AS INT) AS col_start, CAST(col_end AS INT) AS col_end, id FROM ({_RUNS.format('hit')}) AS r")
def _(spark, d):  # noqa: ANN001, ANN202
    return burn_segments(synth.rectangles(spark, d), None, SMALL, "approx").runs


@query("window_materialize", f"{_WRITE} SELECT row - 9 AS row, col - 6 AS col, arg_max(v, rank * 1000000000 + id) AS value FROM wr WHERE row BETWEEN 10 AND 25 AND col BETWEEN 7 AND 21 GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize(results.crop(rect_burn(spark, d), CROP), _values(spark, d), "last", threshold=0.503)


@query("wkb_forms", "SELECT CAST(i AS INT) AS row, CAST(i AS INT) AS col, CAST(i AS INT) AS id FROM range(1, 7) AS t(i)")
def _(spark, d):  # noqa: ANN001, ANN202
    xy = lambda i: (i - 0.5, 10.5 - i)
    forms = [
        struct.pack("<BIdd", 1, 1, *xy(1)), struct.pack(">BIdd", 0, 1, *xy(2)), struct.pack("<BIIdd", 1, 0x20000001, 4326, *xy(3)),
        struct.pack(">BIddd", 0, 0x80000001, *xy(4), 7.0), struct.pack("<BIdddd", 1, 3001, *xy(5), 7.0, 8.0), struct.pack(">BIIBIdd", 0, 4, 1, 0, 1, *xy(6)),
    ]
    return burn(spark.createDataFrame(list(enumerate(forms, 1)), "id int, wkb binary"), grid=Grid(0, 0, 10, 10, 10, 10), keep=False).points


# ---- results as runs, two polygon tables, largest share, other grids, files, WKB of a table, slanted cells -------------------
@query("materialize_runs", f"""{_WRITE}, cell AS (SELECT row, col, arg_max(v, rank * 1000000000 + id) AS value FROM wr GROUP BY row, col),
brk AS (SELECT row, col, value, CASE WHEN lag(col) OVER w = col - 1 AND lag(value) OVER w = value THEN 0 ELSE 1 END AS b FROM cell WINDOW w AS (PARTITION BY row ORDER BY col)),
grp AS (SELECT row, col, value, sum(b) OVER (PARTITION BY row ORDER BY col) AS k FROM brk) SELECT row, CAST(min(col) AS INT) AS col_start, CAST(max(col) AS INT) AS col_end, any_value(value) AS value FROM grp GROUP BY row, k""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    return dense.materialize_runs(rect_burn(spark, d), _values(spark, d), "last", threshold=0.503, check=False)


#: Cells of triangles whose centre is inside, beside the shares of rectangles.
_BOTH = f"{_COVER}, tri AS ({synth.TRIANGLES}), seg AS (SELECT id, ax AS x0, ay AS y0, bx AS x1, bz AS y1 FROM tri UNION ALL SELECT id, bx, bz, cx, cy FROM tri UNION ALL SELECT id, cx, cy, ax, ay FROM tri), tc AS (SELECT id, row, col FROM seg JOIN rr ON least(y0, y1) < ym AND ym <= greatest(y0, y1) JOIN cc ON x0 + (ym - y0) / (y1 - y0) * (x1 - x0) <= xm WHERE y0 <> y1 GROUP BY id, row, col HAVING sum(CASE WHEN y0 >= ym THEN -1 ELSE 1 END) <> 0)"


@query("overlay_areas", f"{_BOTH} SELECT meas.id AS id_1, tc.id AS id_2, count(*) AS cells, floor(sum(m) * 1e6 + 0.26) / 1e6 AS weight FROM meas JOIN tc ON meas.row = tc.row AND meas.col = tc.col GROUP BY 1, 2")
def _(spark, d):  # noqa: ANN001, ANN202
    triangles = burn_segments(synth.triangles(spark, d), None, G, "approx")
    return results.overlay_areas(rect_burn(spark, d), triangles).withColumn("weight", settled("weight", 6))


@query("overlay_polygons", f"{_BOTH} SELECT meas.row, meas.col, meas.id AS id_1, tc.id AS id_2, floor(m * 1e6 + 0.26) / 1e6 AS measure_1, 1e0 AS measure_2 FROM meas JOIN tc ON meas.row = tc.row AND meas.col = tc.col")
def _(spark, d):  # noqa: ANN001, ANN202
    triangles = burn_segments(synth.triangles(spark, d), None, G, "approx")
    return results.overlay(rect_burn(spark, d), triangles).withColumn("measure_1", settled("measure_1", 6))


@query("largest_share", f"""{_COVER}, own AS (SELECT row, col, id, round(sum(m), 9) AS share FROM meas GROUP BY row, col, id)
SELECT row, col, id, floor(share * 1e6 + 0.26) / 1e6 AS share FROM own QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY share DESC, id) = 1""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    return results.by_cell(results.largest_share(rect_burn(spark, d)), "id", "share").withColumn("share", settled("share", 6))


_COARSE = "rr AS (SELECT CAST(i AS INT) AS row, 60 - i * 4e0 AS yl, 60 - (i - 1) * 4e0 AS yh FROM range(1, 16) AS t(i)), cc AS (SELECT CAST(i AS INT) AS col, (i - 1) * 3e0 AS xl, i * 3e0 AS xh FROM range(1, 21) AS t(i))"


@query("coarsened_cells", f"{_COVER.replace(_LINES, _COARSE).replace('/ 3e0 AS f', '/ 12e0 AS f')} SELECT rank, row, col, id, floor(m * 1e6 + 0.26) / 1e6 AS measure FROM meas")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.measures(results.coarsened(rect_burn(spark, d), 2)).withColumn("measure", settled("measure", 6))


@query("moved_cells", ORACLE_SQL["beyond_coverage"])
def _(spark, d):  # noqa: ANN001, ANN202
    return results.measures(results.moved(rect_burn(spark, d), SMALL)).withColumn("measure", settled("measure", 6))


@query("stored_crop", f"{_COVER} SELECT rank, row - 9 AS row, col - 6 AS col, id, floor(m * 1e6 + 0.26) / 1e6 AS measure FROM meas WHERE row BETWEEN 10 AND 25 AND col BETWEEN 7 AND 21")
def _(spark, d):  # noqa: ANN001, ANN202
    path = stored.scratch(spark)
    stored.write_burn(rect_burn(spark, d), path, 8, 16)
    return results.measures(stored.read_burn(spark, path, G, CROP)).withColumn("measure", settled("measure", 6))


@query("stored_tiles", f"{_COVER} SELECT row, col, CAST(arg_max(id, rank * 1000000000 + id) AS DOUBLE) AS value FROM meas WHERE row BETWEEN 5 AND 20 AND col BETWEEN 3 AND 33 GROUP BY row, col")
def _(spark, d):  # noqa: ANN001, ANN202
    path = stored.scratch(spark)
    stored.write_tiles(rect_burn(spark, d), path, 8, 16)
    return results.by_cell(stored.read_tiles(spark, path, (5, 20, 3, 33)), "value")


@query("wkb_coverage", f"{_COVER} SELECT rank, row, col, id, floor(m * 1e6 + 0.26) / 1e6 AS measure FROM meas WHERE id % 10 < 8")
def _(spark, d):  # noqa: ANN001, ANN202
    return results.measures(burn(synth.rectangle_wkb(spark, d), grid=G, keep=False)).withColumn("measure", settled("measure", 6))


@query("wkb_notes", """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 8 THEN 'WKB too short' ELSE 'GeometryCollection is not supported: its members measure different things; split it by kind' END AS message FROM part WHERE p_partkey % 10 >= 8""")
def _(spark, d):  # noqa: ANN001, ANN202
    return burn(synth.rectangle_wkb(spark, d), grid=G, keep=False).notes


_HIT = f"hit AS (SELECT DISTINCT {_CELL} FROM ({synth.POINTS}) AS p WHERE x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 60)"


@query("hit_cell_places", f"WITH {_LINES}, {_HIT} SELECT hit.row, hit.col, xm AS x, ym AS y, xl AS xmin, yl AS ymin, xh AS xmax, yh AS ymax FROM hit JOIN rr ON hit.row = rr.row JOIN cc ON hit.col = cc.col")
def _(spark, d):  # noqa: ANN001, ANN202
    cells = results.cell_centers(point_burn(spark, d).points.select("row", "col").distinct(), G)
    return cells.withColumn("b", box(G, F.col("row"), F.col("col"))).select("row", "col", "x", "y", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


# the width of a triangle inside a cell's columns is linear between the heights of its corners, of the cell's sides and of where its edges meet them
@query("tri_coverage_cells", f"""{_SIDES}, tb AS (SELECT id, least(ax, bx, cx) AS x0, greatest(ax, bx, cx) AS x1, least(ay, bz, cy) AS y0, greatest(ay, bz, cy) AS y1 FROM tri),
cell AS (SELECT id, row, col, xl, xh, yl, yh, greatest(y0, yl) AS lo, least(y1, yh) AS hi FROM tb JOIN cc ON xl < x1 AND xh > x0 JOIN rr ON yl < y1 AND yh > y0),
knot AS (SELECT id, row, col, lo AS y FROM cell UNION SELECT id, row, col, hi FROM cell
UNION SELECT cell.id, row, col, t.y FROM cell JOIN (SELECT id, y0 AS y FROM seg) AS t ON t.id = cell.id AND t.y > lo AND t.y < hi
UNION SELECT cell.id, row, col, y0 + (xl - x0) / (x1 - x0) * (y1 - y0) FROM cell JOIN seg ON seg.id = cell.id AND x0 <> x1 AND xl BETWEEN least(x0, x1) AND greatest(x0, x1) AND y0 + (xl - x0) / (x1 - x0) * (y1 - y0) > lo AND y0 + (xl - x0) / (x1 - x0) * (y1 - y0) < hi
UNION SELECT cell.id, row, col, y0 + (xh - x0) / (x1 - x0) * (y1 - y0) FROM cell JOIN seg ON seg.id = cell.id AND x0 <> x1 AND xh BETWEEN least(x0, x1) AND greatest(x0, x1) AND y0 + (xh - x0) / (x1 - x0) * (y1 - y0) > lo AND y0 + (xh - x0) / (x1 - x0) * (y1 - y0) < hi),
slab AS (SELECT id, row, col, y, lead(y) OVER (PARTITION BY id, row, col ORDER BY y) AS z FROM knot),
mid AS (SELECT slab.id, row, col, y, z, min(x0 + ((y + z) / 2 - y0) / (y1 - y0) * (x1 - x0)) AS l, max(x0 + ((y + z) / 2 - y0) / (y1 - y0) * (x1 - x0)) AS r FROM slab JOIN seg ON seg.id = slab.id AND y0 <> y1 AND (y + z) / 2 BETWEEN least(y0, y1) AND greatest(y0, y1) WHERE z > y GROUP BY slab.id, row, col, y, z),
f AS (SELECT mid.id, mid.row, mid.col, sum((z - y) * greatest(least(r, xh) - greatest(l, xl), 0e0)) / 3e0 AS f FROM mid JOIN cc ON cc.col = mid.col GROUP BY 1, 2, 3)
SELECT row, col, id, CAST(floor(f * 1e4 + 0.26) AS BIGINT) AS parts FROM f WHERE f > 0.00005""")  # fmt: skip
def _(spark, d):  # noqa: ANN001, ANN202
    shares = results.measures(burn_segments(synth.triangles(spark, d), None, G)).where("measure > 0.00005")
    return shares.select("row", "col", "id", F.floor(F.col("measure") * 1e4 + 0.26).alias("parts"))

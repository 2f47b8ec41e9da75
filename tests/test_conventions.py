"""Cases whose results are fixed: parity fixtures as one run over CSV tables, edges of the rules, boxes and old names."""

import csv
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import rings
from meshwright.operators import dense, results
from meshwright.operators.burn import burn, burn_geometries, burn_scanline
from meshwright.plans.grid import Grid
from meshwright.sources.wkb import from_wkt, parse_wkt, read_fixtures
from meshwright.streaming.burns import windowed_counts

TEN, THREE = Grid(0, 0, 10, 10, 10, 10), Grid(0, 0, 3, 3, 3, 3)

# fixed values: case, geometry, extent, columns, rows; covered area, whether edges must be empty, line length, points, tolerance
FIXTURES = [
    ("aligned_rect", "POLYGON ((2 4, 6 4, 6 8, 2 8, 2 4))", (0, 0, 10, 10), 10, 10, 16, 1, "NA", "NA", 1e-9),
    ("offset_rect", "POLYGON ((2.5 4.5, 6.5 4.5, 6.5 8.5, 2.5 8.5, 2.5 4.5))", (0, 0, 10, 10), 10, 10, 16, 0, "NA", "NA", 1e-6),
    ("triangle", "POLYGON ((13.3 17.7, 88.1 22.4, 41.9 79.2, 13.3 17.7))", (0, 0, 100, 100), 37, 41, 2232.89, 0, "NA", "NA", 1e-4),
    ("hole_ccw", "POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 7 3, 7 7, 3 7, 3 3))", (0, 0, 10, 10), 20, 20, 48, 0, "NA", "NA", 1e-6),
    ("hole_cw", "POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 3 7, 7 7, 7 3, 3 3))", (0, 0, 10, 10), 20, 20, 48, 0, "NA", "NA", 1e-6),
    ("multipolygon", "MULTIPOLYGON (((1 1, 3 1, 3 3, 1 3, 1 1)), ((6 6, 9 6, 9 9, 6 9, 6 6)))", (0, 0, 10, 10), 10, 10, 13, 0, "NA", "NA", 1e-6),
    ("beyond_extent", "POLYGON ((-100 -100, 100 -100, 100 100, -100 100, -100 -100))", (0, 0, 10, 10), 5, 5, 100, 1, "NA", "NA", 1e-9),
    ("straddle", "POLYGON ((-5 2.5, 4.5 2.5, 4.5 6.5, -5 6.5, -5 2.5))", (0, 0, 10, 10), 10, 10, 18, 0, "NA", "NA", 1e-6),
    ("line_diagonal", "LINESTRING (0.5 0.5, 9.5 7.5)", (0, 0, 10, 10), 10, 10, "NA", "NA", 11.401754250991, "NA", 1e-4),
    ("points_mixed", "MULTIPOINT ((0.5 9.5), (9.5 0.5), (15 5))", (0, 0, 10, 10), 10, 10, "NA", "NA", "NA", 2, "NA"),
]


def to_wkb(text):
    kind, parts = parse_wkt(text)
    base = {"point": 1, "line": 2, "polygon": 3}[kind]
    xy = lambda c: np.asarray(c, "<f8").tobytes()
    counted = lambda c: struct.pack("<I", len(c)) + xy(c)
    body = {1: lambda p: xy(p[0]), 2: lambda p: counted(p[0]), 3: lambda p: struct.pack("<I", len(p)) + b"".join(map(counted, p))}[base]
    each = [struct.pack("<BI", 1, base) + body(p) for p in parts]
    return struct.pack("<BII", 1, base + 3, len(each)) + b"".join(each) if text.startswith("MULTI") else each[0]


def test_fixtures_as_one_run(spark, tmp_path):
    """Geometry and expectations are CSV tables, joined by case; WKB as hex and WKT must agree."""
    with open(tmp_path / "geometries.csv", "w", newline="") as g, open(tmp_path / "expected.csv", "w", newline="") as e:
        one, two = csv.writer(g), csv.writer(e)
        one.writerow(["case", "wkt", "xmin", "ymin", "xmax", "ymax", "ncol", "nrow", "wkb_hex"])
        two.writerow(["case", "covered_area", "edges_empty", "line_length", "n_points", "tol_rel"])
        for case, text, extent, ncol, nrow, *expected in FIXTURES:
            one.writerow([case, text, *extent, ncol, nrow, to_wkb(text).hex()])
            two.writerow([case, *expected])
    geometries = read_fixtures(spark, f"{tmp_path}/geometries.csv", "case string, wkt string, xmin double, ymin double, xmax double, ymax double, ncol int, nrow int, wkb_hex string")
    expected = read_fixtures(spark, f"{tmp_path}/expected.csv", "case string, covered_area double, edges_empty int, line_length double, n_points int, tol_rel double")
    joined = geometries.join(expected, "case").persist()
    assert joined.count() == len(FIXTURES)
    grids = joined.select("xmin", "ymin", "xmax", "ymax", "ncol", "nrow").distinct().collect()
    seen = 0
    for g in grids:
        own = joined.where(" AND ".join(f"{c} = {g[c]}" for c in g.asDict()))
        rows = own.select(F.col("case").alias("id"), F.unhex("wkb_hex").alias("wkb"))
        for r in (burn(rows, grid=Grid(*g), keep=False), burn_geometries(from_wkt(own.withColumnRenamed("case", "id")), grid=Grid(*g))):
            area = results.covered_area(r, by_id=True).withColumnRenamed("id", "case")
            length = results.line_length(r, by_id=True).withColumnRenamed("id", "case")
            points = r.points.groupBy(F.col("id").alias("case")).agg(F.count("*").alias("points"))
            edges = r.edges.groupBy(F.col("id").alias("case")).agg(F.count("*").alias("edges"))
            done = own
            for t in (area.withColumnRenamed("covered_area", "area"), length, points, edges):
                done = done.join(t, "case", "left")
            for x in done.collect():
                seen += 1
                if x["covered_area"] is not None:
                    assert x["area"] == pytest.approx(x["covered_area"], rel=x["tol_rel"])
                if x["edges_empty"] == 1:
                    assert not x["edges"]
                if x["line_length"] is not None:
                    assert x["length"] == pytest.approx(x["line_length"], rel=x["tol_rel"])
                if x["n_points"] is not None:
                    assert x["points"] == x["n_points"]
    assert seen == 2 * len(FIXTURES)


def burnt(spark, *texts, grid=TEN, mode="coverage"):
    return burn_geometries(from_wkt(spark.createDataFrame(list(enumerate(texts, 1)), "id int, wkt string")), grid=grid, mode=mode)


POLYGONS = {
    "POLYGON ((2 2, 8 2, 8 5, 2 5, 2 2))": 18, "POLYGON ((2 2, 8 2, 5 5, 2 2))": 9, "POLYGON ((2 2, 8 2, 5 3.5, 2 2))": 4.5, "POLYGON ((2 2, 8 2, 8 8, 2 8, 2 2), (4 4, 4 6, 6 6, 6 4, 4 4))": 32,
    "MULTIPOLYGON (((2 2, 5 2, 5 5, 2 5, 2 2)), ((5 5, 8 5, 8 8, 5 8, 5 5)))": 18, "POLYGON ((2 2, 5 2, 8 2, 8 8, 2 8, 2 2))": 36, "POLYGON ((1.1 1.1, 1.2 1.1, 1.15 1.2, 1.1 1.1))": 0.005,
    "POLYGON ((1 5, 9 5, 9 5.01, 1 5.01, 1 5))": 0.08, "POLYGON ((5 1, 5.01 1, 5.01 9, 5 9, 5 1))": 0.08, "POLYGON ((1 1, 1.1 1, 9.1 9, 9 9, 1 1))": 0.8,
}


def test_polygons_keep_their_area(spark):
    areas = {x["id"]: x["covered_area"] for x in results.covered_area(burnt(spark, *POLYGONS), by_id=True).collect()}
    for i, area in enumerate(POLYGONS.values(), 1):
        assert areas[i] == pytest.approx(area, abs=1e-4)
    for n in (1, 2, 500):
        assert results.covered_area(burnt(spark, "POLYGON ((2 2, 8 2, 8 8, 2 8, 2 2))", grid=Grid(0, 0, 10, 10, n, n))).first()[0] == pytest.approx(36)
    plain, split = (dense.to_numpy(dense.materialize_chunk(burnt(spark, t)), TEN, 0.0) for t in ("POLYGON ((2 2, 8 2, 8 8, 2 8, 2 2))", "POLYGON ((2 2, 5 2, 8 2, 8 8, 2 8, 2 2))"))
    assert abs(plain - split).max() < 1e-6


SHARED = [
    ("POLYGON ((2 2, 8 2, 8 5, 2 5, 2 2))", "POLYGON ((2 5, 8 5, 8 8, 2 8, 2 5))"),
    ("POLYGON ((0 0, 3.7 0, 3.7 10, 0 10, 0 0))", "POLYGON ((3.7 0, 10 0, 10 10, 3.7 10, 3.7 0))"),
    ("POLYGON ((0 0, 10 0, 10 10, 0 0))", "POLYGON ((0 0, 10 10, 0 10, 0 0))"),
    ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3.3 3.3, 6.6 3.1, 6.9 6.7, 3.3 3.3))", "POLYGON ((3.3 3.3, 6.6 3.1, 6.9 6.7, 3.3 3.3))"),
    ("POLYGON ((0 0, 10 0, 10 4.3, 4.3 4.3, 4.3 10, 0 10, 0 0))", "POLYGON ((4.3 4.3, 10 4.3, 10 10, 4.3 10, 4.3 4.3))"),
]


@pytest.mark.parametrize("texts", SHARED)
def test_shared_boundaries_add_up(spark, texts):
    sums = results.coverage_sums(burnt(spark, *texts)).collect()
    inside = [x["coverage"] for x in sums]
    assert len(inside) in (36, 100) and all(v == pytest.approx(1, abs=1e-5) for v in inside)


LINES = [
    ("LINESTRING (1 5, 9 5)", TEN, 8.0, None), ("LINESTRING (5 1, 5 9)", TEN, 8.0, None), ("LINESTRING (0.2 0.2, 0.8 0.8)", THREE, 0.72**0.5, 1), ("LINESTRING (0.5 0.5, 0.501 0.501)", THREE, 2**0.5 * 0.001, 1),
    ("LINESTRING (0.5 0.5, 0.5 0.5)", THREE, 0.0, 0), ("LINESTRING (0.5 0.5, 2.5 2.5)", THREE, 8**0.5, 3), ("LINESTRING (0.5 500.5, 999.5 500.5)", Grid(0, 0, 1000, 1000, 1000, 1000), 999.0, 1000),
    ("LINESTRING (0.5 0.5, 999.5 999.5)", Grid(0, 0, 1000, 1000, 1000, 1000), 999 * 2**0.5, None), ("LINESTRING (0.2 0.5, 0.8 0.5, 0.8 0.2, 0.2 0.2, 0.2 0.8)", THREE, 2.1, 1),
    ("LINESTRING (0.5 0.5, 1.5 0.5, 2.5 0.5)", THREE, 2.0, 3), ("LINESTRING (170 0, -170 0)", Grid(-180, -10, 180, 10, 360, 20), 340.0, 340), ("LINESTRING (-1000 -1000, -999 -999)", TEN, 0.0, 0),
]


@pytest.mark.parametrize(("text", "grid", "length", "cells"), LINES)
def test_lines_keep_their_length(spark, text, grid, length, cells):
    r = burnt(spark, text, grid=grid)
    assert results.line_length(r).first()[0] == pytest.approx(length, rel=1e-6, abs=1e-9) and r.runs.isEmpty()
    assert cells is None or r.lines.count() == cells


def test_lines_on_grid_lines_belong_below_and_right(spark):
    r = burnt(spark, "LINESTRING (1 5, 9 5)", "LINESTRING (5 1, 5 9)", "LINESTRING (0 0, 10 0)", "LINESTRING (10 0, 10 10)")
    where = {k: {(x["row"], x["col"]) for x in r.lines.where(F.col("id") == k).collect()} for k in range(1, 5)}
    assert {a for a, _ in where[1]} == {6} and {b for _, b in where[2]} == {6} and {a for a, _ in where[3]} == {10} and {b for _, b in where[4]} == {10}


# fixed values: what a dense rasteriser gives, as the rows and the first and last column of cells whose centre is inside
CENTRES = {
    "POLYGON ((2.3 4.7, 6.3 4.7, 6.3 8.3, 2.3 8.3, 2.3 4.7))": {(r, 3, 6) for r in range(3, 6)},
    "POLYGON ((1 1, 9 1, 5 9, 1 1))": {(3, 5, 6), (4, 5, 6), (5, 4, 7), (6, 4, 7), (7, 3, 8), (8, 3, 8), (9, 2, 9)},
    "POLYGON ((2 4, 6 4, 6 8, 2 8, 2 4))": {(r, 3, 6) for r in range(3, 7)},
    "POLYGON ((2.5 4.5, 6.5 4.5, 6.5 8.5, 2.5 8.5, 2.5 4.5))": {(r, 3, 6) for r in range(2, 6)},
}


@pytest.mark.parametrize("text", CENTRES)
def test_cells_by_centre(spark, text):
    r = burnt(spark, text, mode="approx")
    got = {(x["row"], x["col_start"], x["col_end"]) for x in r.runs.collect()}
    assert r.edges.isEmpty() and got == CENTRES[text]
    centre = lambda row, col: (col - 0.5, 10.5 - row)
    inside = {(row, c) for row, lo, hi in got for c in range(lo, hi + 1)}
    _, [[ring]] = parse_wkt(text)
    for row in range(1, 11):
        for col in range(1, 11):
            x, y = centre(row, col)
            n = sum((1 if q[1] > p[1] else -1) for p, q in zip(ring[:-1], ring[1:], strict=True) if min(p[1], q[1]) < y <= max(p[1], q[1]) and p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) <= x)
            assert ((row, col) in inside) == (n != 0)


def test_halves_own_their_centres(spark):
    r = burnt(spark, "POLYGON ((0 0, 5 0, 5 10, 0 10, 0 0))", "POLYGON ((5 0, 10 0, 10 10, 5 10, 5 0))", mode="approx")
    assert {tuple(x) for x in r.runs.collect()} == {(row, a, b, i) for row in range(1, 11) for a, b, i in ((1, 5, 1), (6, 10, 2))}


def test_box_expressions(spark):
    ring = "array(struct(1.0D AS x, 2.0D AS y), struct(4.0D AS x, 0.5D AS y), struct(3.0D AS x, 6.0D AS y), struct(1.0D AS x, 2.0D AS y))"
    rows = spark.sql(f"SELECT {ring} AS a, transform({ring}, p -> struct(p.x + 2 AS x, p.y + 1 AS y)) AS b, transform({ring}, p -> struct(p.x + 20 AS x, p.y AS y)) AS far")
    a, b, far = (rings.envelope(F.col(c)) for c in ("a", "b", "far"))
    out = rows.select(
        a.alias("box"), rings.boxes_intersect(a, b).alias("meet"), rings.boxes_intersect(a, far).alias("apart"), rings.box_intersection(a, b).alias("both"), rings.box_intersection(a, far).alias("none"),
        rings.box_expand(a, b).alias("all"), rings.box_contains(rings.box_expand(a, b), a).alias("holds"), rings.box_strictly_contains(a, a).alias("strict"), rings.box_contains(a, a).alias("self"),
        rings.box_translate(a, 1.0, -1.0).alias("moved"), rings.length(F.col("a")).alias("length"), rings.signed_area(F.col("a")).alias("area"),
    ).first()
    assert tuple(out["box"]) == (1, 0.5, 4, 6) and out["meet"] and not out["apart"] and tuple(out["both"]) == (3, 1.5, 4, 6) and out["none"] is None
    assert tuple(out["all"]) == (1, 0.5, 6, 7) and out["holds"] and not out["strict"] and out["self"] and tuple(out["moved"]) == (2, -0.5, 5, 5)
    assert out["length"] == pytest.approx(11.25**0.5 + 31.25**0.5 + 20**0.5) and out["area"] == pytest.approx(7.5)


def test_boxes_shrink_to_cells():
    g = Grid(0, 0, 10, 10, 20, 20)
    assert g.shrink_to(1.1, 2.6, 3.0, 4.2) == Grid(1.0, 2.5, 3.0, 4.5, 4, 4) and g.shrink_to(-5, -5, 50, 50) == g
    with pytest.raises(ValueError, match="overlap"):
        g.shrink_to(20, 20, 30, 30)


def test_old_name_of_the_burn(spark):
    rows = spark.createDataFrame([(1, to_wkb("POLYGON ((2 4, 6 4, 6 8, 2 8, 2 4))"))], "id int, wkb binary")
    with pytest.warns(DeprecationWarning):
        r = burn_scanline(rows, grid=TEN, mode="approx", keep=False)
    assert results.covered_area(r).first()[0] == 16


def test_counts_of_windows(spark, tmp_path):
    rows = [(0.5, 0.5, "2024-01-01 00:00:10"), (0.6, 0.4, "2024-01-01 00:00:50"), (0.5, 0.5, "2024-01-01 00:01:10"), (50.0, 5.0, "2024-01-01 00:00:10"), (0.5, 0.5, "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "x double, y double, t string").select("x", "y", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x double, y double, t timestamp").parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, TEN, "t", "1 minute", "10 minutes").writeStream.format("memory").queryName("by_window").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x["window"]["start"].minute, x["row"], x["col"], x["n"]) for x in spark.table("by_window").collect())
    assert got == [(0, 10, 1, 2), (1, 10, 1, 1)]

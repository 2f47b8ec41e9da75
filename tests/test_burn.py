"""Golden cases, conventions, and brute force on random polygons."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import dense, results
from meshwright.operators.burn import burn, burn_geometries, burn_sparse, burn_values
from meshwright.plans.grid import Grid
from meshwright.sources.wkb import GeometryError, as_wkb_list, from_wkb, from_wkt, parse_wkb, parse_wkt

TEN = Grid(0, 0, 10, 10, 10, 10)
BOX = "POLYGON ((2.5 4.5, 6.5 4.5, 6.5 8.5, 2.5 8.5, 2.5 4.5))"


def wkt(spark, *texts, grid=TEN, mode="coverage"):
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "id int, wkt string")
    return burn_geometries(from_wkt(rows), grid=grid, mode=mode)


def area(r):
    return results.covered_area(r).first()[0]


GOLDEN = [
    ("POLYGON ((2 4, 6 4, 6 8, 2 8, 2 4))", TEN, 16, 0),
    (BOX, TEN, 16, 16),
    ("POLYGON ((13.3 17.7, 88.1 22.4, 41.9 79.2, 13.3 17.7))", Grid(0, 0, 100, 100, 37, 41), 2232.89, None),
    ("POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 7 3, 7 7, 3 7, 3 3))", Grid(0, 0, 10, 10, 20, 20), 48, None),
    ("POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 3 7, 7 7, 7 3, 3 3))", Grid(0, 0, 10, 10, 20, 20), 48, None),
    ("MULTIPOLYGON (((1 1, 3 1, 3 3, 1 3, 1 1)), ((6 6, 9 6, 9 9, 6 9, 6 6)))", TEN, 13, None),
    ("POLYGON ((-100 -100, 100 -100, 100 100, -100 100, -100 -100))", Grid(0, 0, 10, 10, 5, 5), 100, 0),
    ("POLYGON ((-5 2.5, 4.5 2.5, 4.5 6.5, -5 6.5, -5 2.5))", TEN, 18, None),
    ("POLYGON ((5.5 1, 9.5 5, 5.5 9, 1.5 5, 5.5 1))", TEN, 32, 30),
]


@pytest.mark.parametrize(("text", "grid", "expected", "edges"), GOLDEN)
def test_golden_areas(spark, text, grid, expected, edges):
    r = wkt(spark, text, grid=grid)
    assert area(r) == pytest.approx(expected, rel=1e-4)
    if edges is not None:
        assert r.edges.count() == edges


def test_readme_polygon_and_line(spark):
    grid = Grid(0, 0, 10, 10, 20, 20)
    text = "POLYGON ((1 1, 8.9 1, 8.9 9.12, 1 9.12, 1 1))"
    r = wkt(spark, text, grid=grid)
    assert results.expand_runs(r.runs).count() == 240
    assert {round(x[0], 4) for x in r.edges.select("fraction").collect()} == {0.24, 0.192, 0.8} and r.edges.count() == 32
    a = wkt(spark, text, grid=grid, mode="approx")
    assert a.runs.count() == 16 and results.expand_runs(a.runs).count() == 256 and a.edges.isEmpty()
    line = wkt(spark, "LINESTRING (0 5, 10 5)", grid=grid).lines.collect()
    assert {x["row"] for x in line} == {11} and all(x["length"] == pytest.approx(0.5) for x in line)


def test_lines(spark):
    r = wkt(spark, "LINESTRING (0.5 0.5, 9.5 7.5)", "LINESTRING (3 3, 3 3)", "MULTILINESTRING ((0.5 0.5, 2.5 0.5), (0.5 0.5, 1.5 0.5))", "LINESTRING (170 0, -170 0)")
    by = {x["id"]: x["length"] for x in results.line_length(r, by_id=True).collect()}
    assert by[1] == pytest.approx(11.401754250991) and r.lines.where("id = 1").count() == 16
    assert 2 not in by and by[3] == pytest.approx(3.0) and by[4] == pytest.approx(10.0)
    assert r.lines.where("id = 3").count() == 5


def test_points(spark):
    three = Grid(0, 0, 3, 3, 3, 3)
    r = wkt(spark, "POINT (1 1)", "MULTIPOINT ((0 0), (3 3), (0 3), (3 0))", "POINT (-1 -1)", "MULTIPOINT ((1.5 1.5), (1.5 1.5), (2.5 2.5))", "POINT EMPTY", grid=three)
    got = sorted((x["id"], x["row"], x["col"]) for x in r.points.collect())
    assert got == [(1, 3, 2), (2, 1, 1), (2, 1, 3), (2, 3, 1), (2, 3, 3), (4, 1, 3), (4, 2, 2), (4, 2, 2)]
    assert results.point_counts(r).where("row = 2 AND col = 2").first()["n"] == 2


def test_small_rings_nulls_and_notes(spark):
    box = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)])
    r = burn_values(spark, [b"\x01\x03\x00", box, None, struct.pack("<BII", 1, 7, 0)], grid=TEN)
    notes = {x["id"]: x["message"] for x in r.notes.collect()}
    assert set(notes) == {1, 4} and "too short" in notes[1] and "GeometryCollection" in notes[4]
    assert [x["id"] for x in results.ids(r).collect()] == [2]
    r.unpersist()
    tiny = wkt(spark, "POLYGON ((1 1, 2 2, 1 1))", "POLYGON ((0.4 0.4, 0.6 0.4, 0.6 0.6, 0.4 0.6, 0.4 0.4))")
    assert [(x["id"], round(x["fraction"], 9)) for x in tiny.edges.collect()] == [(2, 0.04)] and tiny.runs.isEmpty()


def test_wkb_forms():
    x = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    assert parse_wkb(x)[1][0][0].tolist() == [[1.0, 2.0]]
    ewkb = struct.pack("<BIIddd", 1, 1 | 0x80000000 | 0x20000000, 4326, 1.0, 2.0, 9.0)
    iso = struct.pack("<BIdddd", 1, 3001, 1.0, 2.0, 9.0, 8.0)
    assert parse_wkb(ewkb)[1][0][0].tolist() == parse_wkb(iso)[1][0][0].tolist() == [[1.0, 2.0]]
    multi = struct.pack("<BII", 1, 4, 2) + x + struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    assert [p[0].tolist() for p in parse_wkb(multi)[1]] == [[[1.0, 2.0]], [[3.0, 4.0]]]
    for bad, message in ((struct.pack("<BII", 1, 2, 9), "truncated"), (b"\x02" * 9, "byte order"), (struct.pack("<BII", 1, 4, 1) + struct.pack("<BII", 1, 2, 0), "mismatched"), (struct.pack("<BII", 1, 8, 0), "unsupported")):
        with pytest.raises(GeometryError, match=message):
            parse_wkb(bad)
    assert parse_wkt("POLYGON EMPTY") == ("polygon", [])
    with pytest.raises(GeometryError):
        parse_wkt("CIRCLE (1 2)")
    assert as_wkb_list([b"a", None]) == [b"a", None] and as_wkb_list(b"a") == [b"a"]
    with pytest.raises(TypeError, match="cannot interpret"):
        as_wkb_list(3)


def ring(r, n, size):
    """A simple polygon around (5, 5): no gap between angles reaches half a turn."""
    angles = [2 * np.pi * (k + 0.8 * r.random()) / n for k in range(n)]
    pts = [(float(5 + d * np.cos(a)), float(5 + d * np.sin(a))) for a in angles for d in [size * (0.1 + r.random())]]
    return pts if r.random() < 0.5 else pts[::-1]


def clipped(pts, x0, y0, x1, y1):
    """The area of a polygon inside a box, by clipping at each side."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(pts, pts[1:] + pts[:1], strict=True):
            a, b = keep * (p[axis] - bound), keep * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        pts = out
        if not pts:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1], strict=True))) / 2


def winding(pts, x, y):
    n = 0
    for p, q in zip(pts, pts[1:] + pts[:1], strict=True):
        if min(p[1], q[1]) < y <= max(p[1], q[1]) and p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) <= x:
            n += 1 if q[1] > p[1] else -1
    return n


def test_random_polygons_against_brute_force(spark):
    r, grid = random.Random(4), Grid(0, 0, 10, 10, 9, 11)
    rings = [ring(r, r.randint(4, 9), r.choice([0.3, 3, 8])) for _ in range(30)]
    texts = ["POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*p, p[0]]) + "))" for p in rings]
    got = {}
    for x in results.measures(wkt(spark, *texts, grid=grid)).collect():
        got[x["id"], x["row"], x["col"]] = got.get((x["id"], x["row"], x["col"]), 0) + x["measure"]
    centres = {(x["id"], x["row"], x["col"]) for x in results.expand_runs(wkt(spark, *texts, grid=grid, mode="approx").runs).collect()}
    for i, p in enumerate(rings, 1):
        for row in range(1, 12):
            for col in range(1, 10):
                box = grid.cell_box(row, col)
                assert got.get((i, row, col), 0) == pytest.approx(clipped(p, *box) / grid.cell_area, abs=3e-6)
                assert ((i, row, col) in centres) == (winding(p, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2) != 0)


def test_neighbours_add_up_to_one(spark):
    left, right = "POLYGON ((0 0, 3.3 0, 6.1 10, 0 10, 0 0))", "POLYGON ((3.3 0, 10 0, 10 10, 6.1 10, 3.3 0))"
    for x in results.coverage_sums(wkt(spark, left, right, grid=Grid(0, 0, 10, 10, 7, 13))).collect():
        assert x["coverage"] == pytest.approx(1, abs=1e-5)


def test_huge_polygon_and_grid_cost_the_boundary(spark):
    grid = Grid(0, 0, 10, 10, 1_000_000, 20)
    r = wkt(spark, "POLYGON ((-1e6 -1e6, 1e6 -1e6, 1e6 1e6, -1e6 1e6, -1e6 -1e6))", grid=grid)
    assert r.runs.count() == 20 and r.edges.isEmpty() and area(r) == pytest.approx(100)


def test_crop_extract_and_dense(spark):
    r = wkt(spark, "POLYGON ((2 4, 6 4, 6 8, 2 8, 2 4))", "POLYGON ((4 4, 8 4, 8 8, 4 8, 4 4))")
    both = dense.materialize(r, fn="count")
    assert both.count() == 24 and both.where("value = 2").count() == 8 and both.agg(F.sum("value")).first()[0] == 32
    c = results.crop(r, (3.2, 5, 7, 7))
    assert c.shape == (2, 4) and sorted(tuple(x) for x in c.runs.collect()) == [(1, 1, 3, 1), (1, 2, 4, 2), (2, 1, 3, 1), (2, 2, 4, 2)]
    with pytest.warns(UserWarning, match="overlap"):
        assert results.crop(r, (50, 50, 60, 60)).runs.isEmpty()
    ask = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.5, 5.0), (3, 0.5, 0.5), (4, 50.0, 5.0)], "qi long, x double, y double")
    assert dict(map(tuple, results.extract(r, ask, "sum").collect())) == {1: 2.0, 2: 1.0, 3: 0.0, 4: None}
    assert dict(map(tuple, results.extract(r, ask, "id").collect())) == {1: 2.0, 2: 1.0, 3: None, 4: None}
    grid = dense.to_numpy(dense.materialize_chunk(r, "id"), r.grid)
    assert grid[4, 2] == 1 and grid[4, 5] == 2 and np.isnan(grid[0, 0])
    tiles = {(x["tile_row"], x["tile_col"]): np.array(x["values"]).reshape(5, 5) for x in dense.dense_tiles(r, 5).collect()}
    assert all(np.array_equal(t, grid[5 * a : 5 * a + 5, 5 * b : 5 * b + 5], equal_nan=True) for (a, b), t in tiles.items())
    assert dense.materialize(wkt(spark, BOX), fn="sum", edge_policy="fraction").agg(F.sum("value")).first()[0] == pytest.approx(16)
    assert {tuple(x) for x in dense.from_dense(dense.materialize_chunk(r, "id")).where("row = 3").collect()} == {(3, 3, 4, 1.0), (3, 5, 8, 2.0)}
    assert "2 geometries" in results.describe(r)


def test_refusals(spark):
    points, mixed = wkt(spark, "POINT (1 1)"), wkt(spark, "POINT (1 1)", BOX)
    with pytest.raises(NotImplementedError):
        dense.materialize(points)
    for f in (lambda: dense.materialize(mixed), lambda: dense.materialize(points, fn="mean"), lambda: dense.materialize_all(mixed), lambda: results.to_coo(mixed, "x"), lambda: wkt(spark, BOX, mode="x")):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(NotImplementedError):
        burn_sparse()
    assert dense.materialize(wkt(spark, "POINT (50 50)")).isEmpty()
    assert [x["id"] for x in results.ids(mixed.only([2])).collect()] == [2]


def test_extent_from_data_and_decoding_kept(spark):
    box = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in [(0, 0), (5, 0), (5, 10), (0, 10), (0, 0)])
    rows = spark.createDataFrame([(1, box)], "id int, wkb binary")
    r = burn(rows)
    assert r.shape == (256, 128) and r.bounds == (0, 0, 5, 10) and area(r) == pytest.approx(50)
    r.unpersist()
    assert from_wkb(rows).columns == ["id", "kind", "parts", "error"]
    with pytest.raises(ValueError, match="extent"):
        burn(rows.limit(0))


def test_streamed_points(spark, tmp_path):
    from meshwright.streaming.burns import burn_batches, stream_points

    spark.createDataFrame([(1, 0.5, 0.5), (2, 50.0, 5.0)], "id int, x double, y double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, x double, y double").parquet(f"{tmp_path}/in")
    q = stream_points(stream, TEN).writeStream.format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(x) for x in spark.table("cells").collect()] == [(10, 1, 1)]
    box = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in [(0, 0), (5, 0), (5, 10), (0, 10), (0, 0)])
    spark.createDataFrame([(1, box)], "id int, wkb binary").write.parquet(f"{tmp_path}/wkb")
    areas = []
    q = burn_batches(spark.readStream.schema("id int, wkb binary").parquet(f"{tmp_path}/wkb"), TEN, lambda r, n: areas.append(area(r))).start()
    q.processAllAvailable()
    q.stop()
    assert areas == [pytest.approx(50)]

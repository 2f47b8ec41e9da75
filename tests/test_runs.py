"""Rings of many vertices, running sums by blocks, and results that stay runs, against cell-by-cell brute force."""

import collections
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import dense, results, stored
from meshwright.operators import segments as sg
from meshwright.operators.burn import burn, burn_chunks, burn_geometries, burn_segments
from meshwright.operators.polygons import centres, coverage
from meshwright.plans.grid import Grid
from meshwright.sources.wkb import chunks_from_wkb, chunks_from_wkt, from_wkb, from_wkt, turn

TEN = Grid(0, 0, 10, 10, 10, 10)


def polygon_wkb(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in rings)


def coast(n, seed, x=5.0, y=5.0, size=4.0):
    """A simple ring of n vertices whose distance from its centre goes up and down."""
    r = np.random.default_rng(seed)
    a = np.arange(n) * 2 * np.pi / n
    d = size * (0.7 + 0.2 * np.sin(5 * a + seed) + 0.05 * np.sin(37 * a) + 0.02 * r.random(n))
    ring = np.column_stack([x + d * np.cos(a), y + d * np.sin(a)])
    return np.vstack([ring, ring[:1]])


def shoelace(c):
    return abs(float(c[:-1, 0] @ c[1:, 1] - c[1:, 0] @ c[:-1, 1])) / 2


def shapes(spark, n=12, seed=3, size=4.0):
    r = random.Random(seed)
    rows = [(i, polygon_wkb(coast(r.randint(4, 40), i, r.uniform(1, 9), r.uniform(1, 9), size * (0.1 + r.random()))[:: r.choice([1, -1])])) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id int, wkb binary")


def by_cells(r, *keep):
    """(id, row, col): share, parts added."""
    out = collections.defaultdict(float)
    for s in r.spans().collect():
        for c in range(s["col_start"], s["col_end"] + 1):
            out[s["id"], s["row"], c] += s["share"]
    return out


def cells_of(runs, *names):
    return {(s["row"], c): tuple(s[n] for n in names) for s in runs.collect() for c in range(s["col_start"], s["col_end"] + 1)}


def test_chunks_give_the_segments_of_whole_rings(spark):
    df = shapes(spark)
    rows = [(90, polygon_wkb([(1, 1), (9, 1), (9, 9), (1, 9), (1, 1)], [(3, 3), (7, 3), (7, 7), (3, 3)], [(1, 1), (2, 2), (1, 1)])), (91, b"\x01"), (92, None), (93, polygon_wkb([(1, 1), (2, 2), (1, 1)], [(3, 3), (7, 3), (7, 7), (3, 3)]))]
    rows += [(94, struct.pack("<BII6d", 1, 2, 3, 0, 0, 4, 4, 9, 1)), (95, struct.pack("<BII", 1, 3, 0))]
    df = df.unionByName(spark.createDataFrame(rows, "id int, wkb binary"))
    whole = sorted(map(tuple, sg.segments(from_wkb(df)).collect()), key=repr)
    for size in (1, 3, 4096):
        chunks = chunks_from_wkb(df, size=size)
        assert sorted(map(tuple, sg.chunk_segments(chunks).collect()), key=repr) == whole
        assert chunks.agg(F.max(F.size("c"))).first()[0] <= size + 1
        assert {r["id"] for r in chunks.collect()} == {*range(1, 13), *range(90, 96)} and [r["id"] for r in chunks.where("error IS NOT NULL").collect()] == [91]
    assert turn(np.array([[0, 0], [1, 0], [1, 1], [0, 0]], float)) == 1 and turn(np.array([[0, 0], [1, 1], [1, 0], [0, 0]], float)) == -1


def test_long_rings_burn_in_both_modes(spark):
    rings = [coast(100_000, k, 5 + 10 * k, 5) for k in range(4)]
    df = spark.createDataFrame([(k, polygon_wkb(c)) for k, c in enumerate(rings)], "id int, wkb binary")
    grid = Grid(0, 0, 40, 10, 256, 128)
    exact, near = burn(df, grid=grid), burn(df, grid=grid, mode="approx")
    area = {r["id"]: r["covered_area"] for r in results.covered_area(exact, by_id=True).collect()}
    cells = {r["id"]: r["covered_area"] for r in results.covered_area(near, by_id=True).collect()}
    for k, c in enumerate(rings):
        assert area[k] == pytest.approx(shoelace(c), rel=1e-6) and cells[k] == pytest.approx(shoelace(c), rel=0.03)
    exact.unpersist()
    near.unpersist()


def test_no_segment_carries_its_ring(spark):
    """Above the last explode of vertices nothing reads the array of the ring, nor sums over it."""
    rings = spark.createDataFrame([(1, "polygon", 0, 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "id int, kind string, part int, ring int, c array<struct<x:double,y:double>>")
    for rows in (sg.ring_segments(rings), sg.chunk_segments(rings.withColumns({"w": F.lit(1), "first": F.lit(0)}))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
        above = plan[: next(k for k, line in enumerate(plan) if "Generate" in line) + 1]
        assert not any("aggregate(" in line for line in above)
        assert all("[id" not in line or " c#" not in line.split("Project [")[-1] for line in above[:-1])


@pytest.mark.parametrize("mode", ["coverage", "approx"])
def test_blocks_of_columns_change_nothing(spark, mode):
    rows = sg.chunk_segments(chunks_from_wkb(shapes(spark, 8)))
    grid = Grid(0, 0, 10, 10, 37, 23)
    tables = {}
    for block in (1 << 20, 5, 1):
        if mode == "coverage":
            runs, edges, cells = coverage(rows, grid, block)
            tables[block] = (sorted((r["id"], r["row"], r["col"], round(r["fraction"], 9)) for r in edges.collect()), sorted((r["id"], r["row"], c) for r in runs.collect() for c in range(r["col_start"], r["col_end"] + 1)), cells.count())
        else:
            runs, _ = centres(rows, grid, block)
            tables[block] = sorted(map(tuple, runs.collect()))
    assert tables[5] == tables[1] == tables[1 << 20]


def test_no_more_than_boundary_cells_are_exchanged(spark):
    """Each task's pieces are added up by cell before they travel."""
    runs, _, cells = coverage(sg.chunk_segments(chunks_from_wkb(shapes(spark, 2))), TEN)
    plan = cells._jdf.queryExecution().sparkPlan().toString()
    first = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum(cover") == 1 and "partial_sum(cover" in first[first.index("Exchange hashpartitioning(id") :]


def test_overlapping_parts_are_written_in_their_order(spark):
    """Of two parts of one geometry, the first part counts as written first."""
    texts = ["MULTIPOLYGON (((0 0, 0.6 0, 0.6 1, 0 1, 0 0)), ((0 0, 0.9 0, 0.9 1, 0 1, 0 0)))", "MULTIPOLYGON (((0 0, 0.9 0, 0.9 1, 0 1, 0 0)), ((0 0, 0.6 0, 0.6 1, 0 1, 0 0)))"]
    for text, first, last in zip(texts, (0.6, 0.9), (0.9, 0.6), strict=True):
        r = burn_geometries(from_wkt(spark.createDataFrame([(1, text)], "id int, wkt string")), grid=TEN)
        got = [dense.materialize(r, fn=fn, edge_policy="fraction").collect()[0]["value"] for fn in ("first", "last")]
        assert got == [pytest.approx(first), pytest.approx(last)]


@pytest.fixture(scope="module")
def crowd(spark):
    df = shapes(spark, 25, 8)
    r = burn(df, grid=Grid(0, 0, 10, 10, 41, 17))
    return r.with_tables(cells=r.spans().persist())


@pytest.mark.parametrize("width", [4096, 7])
@pytest.mark.parametrize("policy", ["threshold", "fraction"])
def test_reducers_on_runs(spark, crowd, policy, width):
    given = spark.createDataFrame([(i, float(i * 37 % 11)) for i in range(1, 26)], "id int, value double")
    value = {r["id"]: r["value"] for r in given.collect()}
    writes = collections.defaultdict(list)
    for s in crowd.spans().collect():
        rank = 0 if s["share"] == 1 else 1
        if policy == "threshold" and rank and s["share"] < 0.5:
            continue
        for c in range(s["col_start"], s["col_end"] + 1):
            writes[s["row"], c].append((rank, s["id"], s["part"], value[s["id"]] * (s["share"] if policy == "fraction" else 1)))
    for background in (None, 4.0):
        b = [] if background is None else [background]
        rules = {
            "first": lambda v: [*b, *v][0], "last": lambda v: v[-1], "sum": lambda v: sum(b) + sum(v), "min": lambda v: min([*b, *v]), "max": lambda v: max([*b, *v]),
            "count": lambda v: sum(b) + len(v), "any": lambda v: 1.0,
        }
        for fn, rule in rules.items():
            runs = dense.materialize_runs(crowd, given, fn, policy, background=background, check=False, width=width)
            got = cells_of(runs, "value")
            assert got.keys() == writes.keys()
            assert all(got[k][0] == pytest.approx(rule([w[3] for w in sorted(v)])) for k, v in writes.items())
            assert runs.count() < len(writes)


def test_runs_of_values_cost_the_boundary(spark):
    df = spark.createDataFrame([(1, polygon_wkb([(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)])), (2, polygon_wkb([(4, 2), (9, 3), (5, 9), (4, 2)]))], "id int, wkb binary")
    n = {k: dense.materialize_runs(burn(df, grid=Grid(0, 0, 10, 10, k, k), keep=False), fn="sum", check=False, width=1 << 20).count() for k in (500, 1000)}
    assert n[1000] < 2.2 * n[500]


def test_reducers_exchange_spans_once(spark, crowd):
    """Behind the burn there is one exchange, by row and block; grouping and merging use it."""
    plan = dense.materialize_runs(crowd, fn="last", check=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(row") == 1


def test_tables_in_order(spark, crowd):
    runs = results.table(crowd, "runs", expand=True).collect()
    assert [(r["id"], r["row"], r["col"]) for r in runs] == sorted((r["id"], r["row"], r["col"]) for r in runs) and results.table(crowd, "notes").isEmpty()
    with pytest.raises(ValueError, match="name"):
        results.table(crowd, "cells")


def test_largest_share_and_ties(spark, crowd):
    got = cells_of(results.largest_share(crowd), "id", "share")
    best = {}
    for (i, row, col), share in sorted(by_cells(crowd).items()):
        if (row, col) not in best or round(share, 9) > best[row, col][1]:
            best[row, col] = (i, round(share, 9))
    assert got == best
    halves = "POLYGON ((0 0, 0.5 0, 0.5 1, 0 1, 0 0))", "POLYGON ((0.5 0, 1 0, 1 1, 0.5 1, 0.5 0))"
    r = burn_geometries(from_wkt(spark.createDataFrame([(7, halves[0]), (4, halves[1])], "id int, wkt string")), grid=TEN)
    assert cells_of(results.largest_share(r), "id", "share") == {(10, 1): (4, 0.5)}
    parts = "MULTIPOLYGON (((0 0, 0.3 0, 0.3 1, 0 1, 0 0)), ((0.7 0, 1 0, 1 1, 0.7 1, 0.7 0)))"
    r = burn_geometries(from_wkt(spark.createDataFrame([(1, halves[0]), (2, parts)], "id int, wkt string")), grid=TEN)
    assert cells_of(results.largest_share(r), "id")[10, 1] == (2,)


@pytest.mark.parametrize("width", [256, 3])
def test_overlay_of_two_burns(spark, crowd, width):
    other = burn(shapes(spark, 10, 11), grid=crowd.grid, mode="approx", keep=False)
    one, two = collections.defaultdict(list), collections.defaultdict(list)
    for r, out in ((crowd, one), (other, two)):
        for s in r.spans().collect():
            for c in range(s["col_start"], s["col_end"] + 1):
                out[s["row"], c].append((s["id"], round(s["share"], 9)))
    expected = sorted((k, a, b) for k in one.keys() & two.keys() for a in one[k] for b in two[k])
    runs = results.overlay_runs(crowd, other, width)
    got = sorted(((s["row"], c), (s["id_1"], round(s["measure_1"], 9)), (s["id_2"], s["measure_2"])) for s in runs.collect() for c in range(s["col_start"], s["col_end"] + 1))
    assert got == expected and len(got) > 200
    area = {(r["id_1"], r["id_2"]): r["cells"] for r in results.overlay_areas(crowd, other).collect()}
    assert area == collections.Counter((a[0], b[0]) for _, a, b in expected)


def steps_of(df, metric):
    """Name, text and a number of each step of a frame's plan that counts it, after its rows were collected."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        p = nodes.pop()
        name, metrics = p.getClass().getSimpleName(), p.metrics()
        if metrics.contains(metric):
            found.append((name, p.simpleString(100), metrics.get(metric).get().value()))
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        nodes += [*inner, *(p.children().apply(k) for k in range(p.children().size()))]
    return found


def most_joined(df):
    """The largest number of rows that any join of a frame made."""
    return max((n for name, _, n in steps_of(df, "numOutputRows") if "Join" in name), default=0)


@pytest.fixture(scope="module")
def heap(spark):
    """300 equal squares over four cells and 20 others, and 400 points in these."""
    box = lambda i, x: (i, polygon_wkb([(x, 1), (x + 1.5, 1), (x + 1.5, 3), (x, 3), (x, 1)]))
    squares = spark.createDataFrame([box(i, 2.0) for i in range(300)] + [box(i, 6.0) for i in range(300, 320)], "id int, wkb binary")
    points = spark.createDataFrame([(i, 2.5 + i % 2, 1.5 + i % 3 / 2) for i in range(400)], "qi int, x double, y double")
    return burn(squares, grid=TEN, keep=False), points


@pytest.mark.parametrize("fun", ["id", "sum"])
def test_lookup_makes_no_pairs_of_points_and_entries(spark, heap, fun):
    r, points = heap
    found = results.extract(r, points, fun, check=False)
    got = {q["qi"]: q["value"] for q in found.collect()}
    # edges are written after runs; the even points lie in whole cells, the odd ones in half cells
    assert got == {i: 299.0 if fun == "id" else (150.0 if i % 2 else 300.0) for i in range(400)}
    assert 0 < most_joined(found) <= 400


def test_sums_of_an_overlay_make_no_pairs(spark, heap):
    r, points = heap
    other = burn_segments(points.selectExpr("qi AS id"), points.withColumnRenamed("qi", "id"), TEN, kind="point")
    sums = results.overlay_sums(r, other)
    got = {(s["row"], c): (s["n"], s["total_1"], s["total_2"]) for s in sums.collect() for c in range(s["col_start"], s["col_end"] + 1)}
    assert 0 < most_joined(sums) <= 10
    pairs = results.overlay(r, other).groupBy("row", "col").agg(F.count("*"), F.sum("measure_1"), F.sum("measure_2"))
    assert got == {(p[0], p[1]): tuple(p[2:]) for p in pairs.collect()} and sum(n for n, _, _ in got.values()) == 300 * 400


def test_areas_of_equal_geometries_are_added_once(spark, heap):
    """Pairs of entries are made for one of the equal geometries; only pairs of ids come out for the others."""
    r, _ = heap
    whole = burn(spark.createDataFrame([(i, polygon_wkb([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])) for i in (7, 8)], "id int, wkb binary"), grid=TEN, mode="approx", keep=False)
    areas = results.overlay_areas(r, whole)
    assert {tuple(a) for a in areas.collect()} == {(i, k, 4, 3.0) for i in range(320) for k in (7, 8)}
    assert 0 < most_joined(areas) <= 640


def test_areas_of_equal_geometries_are_not_joined_for_each(spark, heap):
    """Ids that are alike go through joins as arrays: fewer rows than the 640 that come out."""
    r, _ = heap
    whole = burn(spark.createDataFrame([(i, polygon_wkb([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])) for i in (7, 8)], "id int, wkb binary"), grid=TEN, mode="approx", keep=False)
    areas = results.overlay_areas(r, whole)
    assert len(areas.collect()) == 640
    assert 0 < most_joined(areas) <= 320


def test_equal_entries_of_an_overlay_meet_as_one_row(spark, heap):
    """Joins make few rows for 320 squares under 50 equal ones; rows of all pairs of ids come out behind them, also of a null id."""
    r, _ = heap
    whole = burn(spark.createDataFrame([(i, polygon_wkb([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])) for i in range(50)], "id int, wkb binary"), grid=TEN, mode="approx", keep=False)
    cells = results.overlay(r, whole)
    got = collections.Counter(tuple(c) for c in cells.collect())
    squares = [(9 + k // 2, 3 + k % 2 if i < 300 else 7 + k % 2, i, 0.5 if k % 2 else 1.0) for i in range(320) for k in range(2 * 2)]
    assert got == {(row - 1, col, i, k, share, 1.0): 1 for row, col, i, share in squares for k in range(50)}
    assert 0 < most_joined(cells) <= 1000
    rows = results.gathered(spark.createDataFrame([(1, 5), (1, None), (2, 5), (1, 5)], "place int, id int"), "place").collect()
    assert collections.Counter((g["place"], i["id"]) for g in rows for i in g["ids"]) == {(1, 5): 2, (1, None): 1, (2, 5): 1}


@pytest.mark.parametrize("far", [0, 3, 40])
def test_overlay_meets_only_what_overlaps(spark, far):
    """Spans of one row: joins make the rows that come out and no others."""
    grid, r = Grid(0, 0, 100, 1, 100, 1), random.Random(far)
    spans = [[(i, a, min(99, a + r.randrange(far + 1))) for i, a in enumerate(r.randrange(100) for _ in range(60))] for _ in range(2)]
    burns = [burn(spark.createDataFrame([(i, polygon_wkb([(a, 0), (b + 1, 0), (b + 1, 1), (a, 1), (a, 0)])) for i, a, b in s], "id int, wkb binary"), grid=grid, mode="approx", keep=False) for s in spans]
    runs = results.overlay_runs(*burns)
    got = sorted((s["id_1"], s["id_2"], s["col_start"] - 1, s["col_end"] - 1) for s in runs.collect())
    assert got == sorted((i, k, max(a, c), min(b, d)) for i, a, b in spans[0] for k, c, d in spans[1] if a <= d and c <= b) and got
    assert most_joined(runs) <= len(got)


def zigzags(spark, n=200):
    """n lines up and down over 10 x 10 cells."""
    steps = [(i, "line", 0, 0, k, float(k), 9.75 * (k % 2) + 0.125, k + 1.0, 9.75 * ((k + 1) % 2) + 0.125, None) for i in range(n) for k in range(9)]
    return spark.createDataFrame(steps, "id int, kind string, part int, ring int, seq int, x0 double, y0 double, x1 double, y1 double, w int")


def test_lines_are_dealt_out_before_they_are_added_up(spark, monkeypatch):
    """Partitions of the input don't decide how much one task adds up, and bands of rows make no difference."""
    from meshwright.operators import lines

    rows, found = zigzags(spark).repartition("id"), []
    for band in (1, 4, 8, 100):
        monkeypatch.setattr(lines, "BAND", band)
        cells = lines.line_cells(rows, TEN)
        found.append(sorted((c["id"], c["row"], c["col"], round(c["length"], 9)) for c in cells.collect()))
        dealt = [n for _, text, n in steps_of(cells, "shuffleRecordsWritten") if "hashpartitioning(id" in text and "band" in text]
        assert dealt == [200 * 9 * -(-10 // band)]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 200 * 90
    assert sum(c[3] for c in found[0]) == pytest.approx(200 * 9 * math.hypot(1, 9.75))


def test_chunks_add_up_equal_places_before_spans_are_cut(spark):
    r = burn_segments(zigzags(spark), None, TEN, kind="line")
    runs = dense.chunk_runs(r, "sum")
    total = sum((c["col_end"] - c["col_start"] + 1) * c["value"] for c in runs.collect())
    assert total == pytest.approx(200 * 9 * math.hypot(1, 9.75))
    placed = [n for _, text, n in steps_of(runs, "shuffleRecordsWritten") if "hashpartitioning(row" in text and "block" in text]
    assert placed and max(placed) <= 100


@pytest.mark.parametrize("width", [256, 4])
def test_zonal_by_running_sums(spark, crowd, width):
    r = random.Random(2)
    raster = {(row, col): r.choice([1.5, -2.0, 10.0, None]) for row in range(1, 18) for col in range(1, 42) if r.random() < 0.6 and not 20 < col < 30 and row != 5}
    raster[9, 12], raster[9, 20] = float("nan"), float("inf")
    frame = spark.createDataFrame([(a, b, v) for (a, b), v in raster.items()], "row int, col int, value double")
    weight, total = collections.defaultdict(float), collections.defaultdict(float)
    for (i, row, col), share in by_cells(crowd).items():
        v = raster.get((row, col))
        if v is not None:
            weight[i] += share
            total[i] += share * v if math.isfinite(v) else math.nan
    got = {z["id"]: z for z in results.zonal(crowd, frame, width=width).collect()}
    assert got.keys() == weight.keys()
    for i, z in got.items():
        assert z["weight"] == pytest.approx(weight[i]) and z["total"] == pytest.approx(total[i], nan_ok=True)
    assert any(math.isnan(z["total"]) for z in got.values())


def test_other_grids(spark):
    df = shapes(spark, 10, 5)
    fine, coarse = Grid(0, 0, 12, 12, 48, 36), Grid(0, 0, 12, 12, 12, 9)
    a, b = by_cells(results.coarsened(burn(df, grid=fine, keep=False), 4)), by_cells(burn(df, grid=coarse, keep=False))
    assert all(a[k] == pytest.approx(b[k], abs=2e-5) for k in a.keys() | b.keys())
    window = Grid(2, 1, 9, 20, 28, 57)
    c, d = by_cells(results.moved(burn(df, grid=fine, keep=False), window)), by_cells(burn(df, grid=window, keep=False))
    assert all(c[k] == pytest.approx(d[k], abs=1e-6) for k in c) and c.keys() == {k for k in d if k[1] > 24}  # the first grid ends 24 rows below the window's top
    both = burn(df, grid=fine, keep=False)
    runs = results.moved(both, window).runs
    assert sorted((r["id"], r["row"], k) for r in runs.collect() for k in range(r["col_start"], r["col_end"] + 1)) == sorted(k for k, v in d.items() if v == 1)
    with pytest.raises(ValueError, match="line up"):
        results.moved(both, Grid(0.1, 0, 12.1, 12, 48, 36))
    with pytest.raises(ValueError, match="factor"):
        results.coarsened(both, 5)


def test_overlay_of_aligned_grids(spark):
    """Burns of two aligned grids, moved to the grid they share, are overlaid as if both had been burnt there."""
    left, right = Grid(0, 0, 8, 10, 16, 20), Grid(3, 2, 12, 12, 18, 20)
    one, two = shapes(spark, 6, 21), shapes(spark, 6, 22)
    shared = left.overlap(right)
    moved = results.overlay(results.moved(burn(one, grid=left, keep=False), shared), results.moved(burn(two, grid=right, keep=False), shared))
    direct = results.overlay(burn(one, grid=shared, keep=False), burn(two, grid=shared, keep=False))
    plain = lambda t: sorted((r["row"], r["col"], r["id_1"], r["id_2"], round(r["measure_1"], 6), round(r["measure_2"], 6)) for r in t.collect())
    assert plain(moved) == plain(direct) and plain(direct)


def test_stored_burns_are_read_by_window(spark, tmp_path, crowd):
    stored.write_burn(crowd, f"{tmp_path}/burn", 8, 12)
    manifest = spark.read.parquet(f"{tmp_path}/burn/manifest").collect()
    assert len(manifest) > 6 and sum(m["entries"] for m in manifest) == spark.read.parquet(f"{tmp_path}/burn/data").count()
    every = stored.read_ordered(spark, f"{tmp_path}/burn")
    small, wide = (stored.read_ordered(spark, f"{tmp_path}/burn", w) for w in ((1, 3, 1, 6), (1, 12, 1, 30)))
    assert len(small.inputFiles()) < len(wide.inputFiles()) <= len(every.inputFiles())
    box = (2.2, 3.1, 7.9, 8.4)
    window, direct = stored.read_burn(spark, f"{tmp_path}/burn", crowd.grid, box), results.crop(crowd, box)
    assert window.grid == direct.grid
    plain = lambda r: {k: round(v, 9) for k, v in by_cells(r).items()}
    assert plain(window) == plain(direct) and plain(stored.read_burn(spark, f"{tmp_path}/burn", crowd.grid)) == plain(crowd)
    assert sorted(map(tuple, window.edges.collect())) == sorted(map(tuple, direct.edges.collect()))
    stored.write_tiles(crowd, f"{tmp_path}/tiles", 8, 6)
    ids = {(r["row"], r["col"]): r["value"] for r in dense.materialize_chunk(crowd, "id").collect()}
    assert {k: v[0] for k, v in cells_of(stored.read_tiles(spark, f"{tmp_path}/tiles"), "value").items()} == ids
    part = cells_of(stored.read_tiles(spark, f"{tmp_path}/tiles", (4, 9, 10, 20)), "value")
    assert {k: v[0] for k, v in part.items()} == {k: v for k, v in ids.items() if 4 <= k[0] <= 9 and 10 <= k[1] <= 20}
    assert stored.read_tiles(spark, f"{tmp_path}/tiles", (100, 120, 1, 2)).isEmpty()


def test_a_hot_tile_is_several_files(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 8 + 1).cast("int").alias("row"), F.lit(1).alias("col_start"), F.lit(3).alias("col_end"), F.col("id"))
    rows = rows.unionByName(spark.range(100).select((F.col("id") + 20).cast("int").alias("row"), F.lit(50).alias("col_start"), F.lit(50).alias("col_end"), F.col("id")))
    stored.write_ordered(rows, f"{tmp_path}/hot", 16, 6)
    assert spark.read.parquet(f"{tmp_path}/hot/manifest").agg(F.max("entries")).first()[0] < 12_000


def test_streams_burn_in_place_like_batches(spark, tmp_path):
    from meshwright.streaming.sweep import stream_burn

    rows = [tuple(r) for r in shapes(spark, 14, 31, 9.0).collect()]
    rows += [(50, struct.pack("<BII8d", 1, 2, 4, 0.5, 0.5, 9.5, 7.5, 12, 5, 10, 5)), (51, struct.pack("<BIdd", 1, 1, 3.0, 10.0)), (52, None), (53, b"\x01\x02")]
    rows += [(54, struct.pack("<BII", 1, 6, 2) + polygon_wkb(coast(9, 1)) + polygon_wkb(coast(30, 2), coast(20, 3, size=1.5))), (55, struct.pack("<BII4d", 1, 2, 2, 10, 0, 10, 10))]
    spark.createDataFrame(rows, "id int, wkb binary").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id int, wkb binary").parquet(f"{tmp_path}/in")
    for mode in ("coverage", "approx"):
        grid = Grid(0, 0, 10, 10, 19, 13)
        q = stream_burn(source, grid, mode).writeStream.format("memory").queryName(f"swept_{mode}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        batch = burn(spark.read.parquet(f"{tmp_path}/in"), grid=grid, mode=mode, keep=False)
        plain = lambda t: collections.Counter((r["id"], r["rank"], r["row"], c, round(r["measure"], 7)) for r in t.collect() for c in range(r["col_start"], r["col_end"] + 1))
        assert plain(spark.table(f"swept_{mode}")) == plain(results.pieces(batch))


@pytest.mark.filterwarnings("ignore:geometry")
def test_chunks_of_text_and_notes(spark):
    df = spark.createDataFrame([(1, "POLYGON ((2 4, 6 4, 6 8, 2 8, 2 4))"), (2, "nonsense"), (3, None)], "id int, wkt string")
    r = burn_chunks(chunks_from_wkt(df), bounds=(0, 0, 10, 10), shape=(10, 10), spread=False)
    assert results.covered_area(r).first()[0] == 16 and [n["id"] for n in r.notes.collect()] == [2]
    with pytest.warns(UserWarning, match="geometry 2: WKT not understood"):
        r.warn()
    many = r.with_tables(notes=spark.range(150).select("id", F.lit("odd").alias("message")))
    with pytest.warns(UserWarning, match="50 more geometries"):
        many.warn()
    empty = burn_segments(sg.chunk_segments(chunks_from_wkt(df.limit(0))), None, TEN)
    assert results.covered_area(empty).first()[0] == 0 and dense.materialize(empty, check=False).isEmpty() and results.largest_share(empty).isEmpty()

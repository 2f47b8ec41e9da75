"""Geometry made from the test tables by whole-number arithmetic over eighths, so that any engine makes the same numbers."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.segments import ring_segments
from meshwright.plans.grid import Grid

#: Cells of 1.5 x 2.
GRID = Grid(0.0, 0.0, 60.0, 60.0, 40, 30)

#: Rectangles of parts: exteriors, holes for some, second parts for some. Both engines run this text.
RECTANGLES = """
SELECT id, part, ring, x0 AS ax, y0 AS ay, x0 + wd AS bx, y0 + ht AS bz FROM (
SELECT p_partkey AS id, 0 AS part, 0 AS ring, (p_partkey * 7 % 400) / 8e0 AS x0, (p_partkey * 13 % 400) / 8e0 AS y0, (p_partkey % 24 + 8) / 8e0 AS wd, (p_partkey % 40 + 8) / 8e0 AS ht FROM part
UNION ALL
SELECT p_partkey, 0, 1, (p_partkey * 7 % 400) / 8e0 + (p_partkey % 24 + 8) / 32e0, (p_partkey * 13 % 400) / 8e0 + (p_partkey % 40 + 8) / 32e0, (p_partkey % 24 + 8) / 16e0, (p_partkey % 40 + 8) / 16e0 FROM part WHERE p_size % 3 = 0
UNION ALL
SELECT p_partkey, 1, 0, (p_partkey * 7 % 400) / 8e0 + 6, (p_partkey * 13 % 400) / 8e0 + 7, (p_partkey % 24 + 8) / 8e0, (p_partkey % 40 + 8) / 8e0 FROM part WHERE p_size % 5 = 0) AS q
"""

#: Triangles of suppliers, of either orientation.
TRIANGLES = """
SELECT s_suppkey AS id, (s_suppkey * 11 % 300) / 8e0 AS ax, (s_suppkey * 17 % 300) / 8e0 AS ay,
(s_suppkey * 11 % 300) / 8e0 + (s_suppkey % 40 + 8) / 4e0 AS bx, (s_suppkey * 17 % 300) / 8e0 + (s_suppkey % 24) / 8e0 AS bz,
(s_suppkey * 11 % 300) / 8e0 + (s_suppkey % 16) / 8e0 AS cx, (s_suppkey * 17 % 300) / 8e0 + (s_suppkey % 2) * 20 - (s_suppkey % 32 + 9) / 4e0 + 9 AS cy FROM supplier
"""

#: Points of events; steps of 1/8, so some lie on grid lines and on the edges of the extent.
POINTS = "SELECT event_id AS id, (event_id * 37 % 500) / 8e0 AS x, (event_id * 53 % 500) / 8e0 AS y FROM events"

#: Consecutive events of each user; odd sixteenths, so no segment runs along a grid line.
STEPS = """
SELECT user_id AS id, seq, x0, y0, x1, y1 FROM (
SELECT user_id, event_id AS seq, (event_id * 37 % 464) / 8e0 + 1 / 16e0 AS x0, (event_id * 53 % 464) / 8e0 + 1 / 16e0 AS y0,
(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 37 % 464) / 8e0 + 1 / 16e0 AS x1,
(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 53 % 464) / 8e0 + 1 / 16e0 AS y1 FROM events) AS q WHERE x1 IS NOT NULL
"""

#: A raster of mean prices by cell.
RASTER = "SELECT CAST(l_orderkey % 30 + 1 AS INT) AS row, CAST(l_partkey % 40 + 1 AS INT) AS col, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"


def view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A query over the named tables."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def _closed(df: DataFrame, corners: list[tuple[str, str]], turned) -> DataFrame:  # noqa: ANN001
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (*corners, corners[0])))
    ring = F.when(turned, F.reverse(ring)).otherwise(ring)
    return ring_segments(df.select("id", F.lit("polygon").alias("kind"), "part", "ring", ring.alias("c")))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted segments of the rectangles."""
    return _closed(view(spark, sf_dir, RECTANGLES, "part"), [("ax", "ay"), ("bx", "ay"), ("bx", "bz"), ("ax", "bz")], F.col("id") % 2 == 1)


def _wkb_of(id_: int, parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """A MultiPolygon in one of several forms, by the id: either byte order, with an SRID, with z, and with z and m; broken bytes and a collection for some."""
    if id_ % 10 == 8:
        return b"\x01\x06\x00"
    if id_ % 10 == 9:
        return struct.pack("<BII", 1, 7, 0)
    order, form = ("<", ">")[id_ % 2], id_ % 4
    flag, extra = ((0, ()), (0x80000000, (7.0,)), (3000, (7.0, 8.0)), (0x20000000, ()))[form]
    head = lambda base, srid: struct.pack(f"{order}BI", order == "<", base + flag if srid or form != 3 else base) + (struct.pack(f"{order}I", 4326) if srid and form == 3 else b"")
    body = [head(3, False) + struct.pack(f"{order}I", len(rings)) + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + len(extra)}d", *p, *extra) for p in r) for r in rings) for rings in parts]
    return head(6, True) + struct.pack(f"{order}I", len(body)) + b"".join(body)


def rectangle_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and wkb of the rectangles, one geometry a part of the table, holes and second parts included."""
    rows = view(spark, sf_dir, RECTANGLES, "part").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "ring", "ax", "ay", "bx", "bz"))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, rings in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                parts: dict[int, list] = {}
                for q in rings:
                    box = [(q["ax"], q["ay"]), (q["bx"], q["ay"]), (q["bx"], q["bz"]), (q["ax"], q["bz"]), (q["ax"], q["ay"])]
                    parts.setdefault(q["part"], []).append(box[:: (-1) ** (i % 3)])
                out.append(_wkb_of(i, list(parts.values())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "wkb"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, wkb binary")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted segments of the triangles."""
    rows = view(spark, sf_dir, TRIANGLES, "supplier").withColumns({"part": F.lit(0), "ring": F.lit(0)})
    return _closed(rows, [("ax", "ay"), ("bx", "bz"), ("cx", "cy")], F.lit(False))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the users' lines."""
    rows = view(spark, sf_dir, STEPS, "events")
    return rows.select("id", F.lit("line").alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", "x0", "y0", "x1", "y1", F.lit(None).cast("int").alias("w"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POINTS, "events")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RASTER, "lineitem")


def coasts(spark: SparkSession, rings: int = 4, vertices: int = 1_000_000, across: int = 4, chunk: int = 4096) -> DataFrame:
    """Vertex chunks (see :func:`meshwright.sources.wkb.chunks_from_wkb`) of jagged rings in squares of 15, so many of them side by side, computed by Spark."""
    last = vertices - 1
    chunks = spark.range(rings).select("id", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(chunk))).alias("first")).repartition("id", "first")

    def vertex(k: Column) -> Column:
        turn = k.cast("double") * (2 * math.pi / vertices)
        far = 7 * (0.8 + 0.12 * F.sin(5 * turn) + 0.05 * F.sin(997 * turn) + 0.02 * F.sin(99_991 * turn))
        return F.struct((15 * (F.col("id") % across) + 7.5 + far * F.cos(turn)).alias("x"), (15 * F.floor(F.col("id") / across) + 7.5 + far * F.sin(turn)).alias("y"))

    c = F.transform(F.sequence(F.col("first"), F.least(F.col("first") + chunk, F.lit(vertices))), lambda k: vertex(F.pmod(k, F.lit(vertices))))
    constant = {"kind": F.lit("polygon"), "error": F.lit(None).cast("string"), "part": F.lit(0), "ring": F.lit(0), "n": F.lit(vertices + 1), "w": F.lit(1)}
    return chunks.withColumns(constant | {"c": c}).select("id", "kind", "error", "part", "ring", "first", "n", "w", "c")

"""WKB and WKT decoding. Bytes to doubles is the one step that Spark has no expression for, so it runs over Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What decoding adds to a row: kind (polygon, line, point), parts as part > ring > coordinates, and an error.
GEOMETRY = "kind string, parts array<array<array<struct<x:double,y:double>>>>, error string"
_KINDS = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon"}


class GeometryError(ValueError):
    """Bytes or text that are no geometry of a supported kind."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, form: str, size: int):  # noqa: ANN201
        if self.at + size > len(self.data):
            raise GeometryError(f"WKB truncated at byte {self.at}")
        self.at += size
        return struct.unpack_from(self.order + form, self.data, self.at - size)[0]

    def header(self) -> tuple[int, int]:
        """Base type and ordinates of a coordinate; a nested header may set another byte order."""
        raw = self.take("I", 4)
        thousands, base = divmod(raw & 0x0FFFFFFF, 1000)
        dims = 2 + bool(raw & 0x80000000) + bool(raw & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}.get(thousands, 0)
        if raw & 0x20000000:
            self.take("I", 4)
        return base if thousands < 4 else raw & 0x0FFFFFFF, dims

    def coordinates(self, n: int, dims: int) -> np.ndarray:
        if self.at + 8 * dims * n > len(self.data):
            whole = (len(self.data) - self.at) // 8
            raise GeometryError(f"WKB truncated at byte {self.at + 8 * whole}")
        out = np.frombuffer(self.data, self.order + "f8", n * dims, self.at).reshape(n, dims)[:, :2]
        self.at += 8 * dims * n
        return out.astype("f8")

    def body(self, base: int, dims: int) -> list[np.ndarray]:
        if base == 1:
            return [self.coordinates(1, dims)]
        if base == 2:
            return [self.coordinates(self.take("I", 4), dims)]
        return [self.coordinates(self.take("I", 4), dims) for _ in range(self.take("I", 4))]


def parse_wkb(data: bytes) -> tuple[str, list[list[np.ndarray]]]:
    """Kind and parts (lists of rings or of one line or point) of WKB or EWKB bytes; more ordinates than x and y are dropped."""
    if len(data) < 5:
        raise GeometryError("WKB too short")
    if data[0] > 1:
        raise GeometryError("WKB invalid byte order flag")
    r = _Reader(data)
    r.order = "><"[r.take("B", 1)]
    base, dims = r.header()
    if base == 7:
        raise GeometryError("GeometryCollection is not supported: its members measure different things; split it by kind")
    if base not in _KINDS:
        raise GeometryError(f"WKB unsupported geometry type {base}; linearise curves first")
    if base <= 3:
        return _KINDS[base], [r.body(base, dims)]
    parts = []
    for _ in range(r.take("I", 4)):
        r.order = "<" if r.take("B", 1) == 1 else ">"
        inner, dims = r.header()
        if inner != base - 3:
            raise GeometryError(f"WKB multi-geometry contains mismatched part type {inner}")
        parts.append(r.body(inner, dims))
    return _KINDS[base], parts


_WKT = re.compile(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(ZM|Z|M)?\s*(EMPTY|\(.*\))\s*$", re.I | re.S)


def parse_wkt(text: str) -> tuple[str, list[list[np.ndarray]]]:
    """Kind and parts of WKT."""
    m = _WKT.match(text)
    if not m:
        raise GeometryError(f"WKT not understood: {text[:60]!r}")
    kind = {"POINT": "point", "LINESTRING": "line", "POLYGON": "polygon"}[m[2].upper()]
    if m[4].upper() == "EMPTY":
        return kind, [[np.full((1, 2), np.nan)]] if kind == "point" and not m[1] else []
    runs = re.sub(r"[^()]+", lambda r: repr([[float(v) for v in p.split()[:2]] for p in r[0].split(",") if p.strip()])[1:-1] if re.search(r"\d|nan", r[0], re.I) else ",", m[4])
    import ast

    nested = ast.literal_eval(runs.replace("(", "[").replace(")", "]"))
    depth = lambda x: 1 + depth(x[0]) if isinstance(x, list) and x else 0
    if kind == "point":
        flat = [p[0] if isinstance(p[0], list) else p for p in nested]
        return kind, [[np.array([p], float)] for p in flat]
    if kind == "line":
        return kind, [[np.array(part, float)] for part in (nested if depth(nested) == 3 else [nested])]
    return kind, [[np.array(ring, float) for ring in part] for part in (nested if depth(nested) == 4 else [nested])]


def _columns(values: list, parse) -> tuple[pa.Array, pa.Array, pa.Array]:  # noqa: ANN001
    kinds, errors, polys, rings, xs = [], [], [0], [0], []
    counts = [0]
    for v in values:
        kind, parts, error = None, [], None
        if v:
            try:
                kind, parts = parse(v)
            except GeometryError as e:
                error = str(e)
        kinds.append(kind)
        errors.append(error)
        for part in parts:
            for ring in part:
                xs.append(ring)
                counts.append(counts[-1] + len(ring))
            rings.append(rings[-1] + len(part))
        polys.append(polys[-1] + len(parts))
    xy = np.concatenate(xs) if xs else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    nest = points
    for offsets in (counts, rings, polys):
        nest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nest)
    return pa.array(kinds, pa.string()), nest, pa.array(errors, pa.string())


def _decoded(df: DataFrame, id: str, column: str, parse) -> DataFrame:  # noqa: ANN001, A002
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(b.column(1).to_pylist(), parse)], names=["id", "kind", "parts", "error"])

    return df.select(F.col(id).alias("id"), F.col(column)).mapInArrow(run, f"id {kind}, {GEOMETRY}")


def from_wkb(df: DataFrame, id: str = "id", wkb: str = "wkb") -> DataFrame:  # noqa: A002
    """id, kind, parts, error of each row. A null or empty geometry keeps its row, without kind, parts or error."""
    return _decoded(df, id, wkb, parse_wkb)


def from_wkt(df: DataFrame, id: str = "id", wkt: str = "wkt") -> DataFrame:  # noqa: A002
    """As :func:`from_wkb`, from text."""
    return _decoded(df, id, wkt, parse_wkt)


#: Vertices of a chunk, and of an Arrow batch of chunks.
CHUNK, BATCH = 4096, 1 << 18
#: What a chunk adds to a row. Chunks of a ring share a vertex; first is the number of a chunk's first segment, n the ring's vertices, w a
#: polygon ring's winding weight (0: not burnt, for a ring or an exterior of less than four coordinates).
CHUNKS = "kind string, error string, part int, ring int, first int, n int, w int, c array<struct<x:double,y:double>>"


def turn(ring: np.ndarray) -> int:
    """1 for a counter-clockwise ring, else -1; x and y are taken from the first vertex, for accuracy."""
    x, y = (ring - ring[:1]).T
    return 1 if len(ring) >= 3 and float(x[:-1] @ y[1:] - x[1:] @ y[:-1]) > 0 else -1


def _chunks_of(id_: object, value: bytes | str | None, parse, size: int) -> Iterator[tuple]:  # noqa: ANN001
    """The chunks of one geometry; one row without coordinates if it has none."""
    kind, parts, error = None, [], None
    if value:
        try:
            kind, parts = parse(value)
        except GeometryError as e:
            error = str(e)
    none = True
    for part, rings in enumerate(parts):
        for k, ring in enumerate(rings):
            w = None
            if kind == "polygon":
                w = turn(ring) * (1 if k == 0 else -1) if len(ring) >= 4 and len(rings[0]) >= 4 else 0
            for at in range(0, max(1, len(ring) - 1), size):
                none = False
                yield id_, kind, None, part, k, at, len(ring), w, ring[at : at + size + 1]
    if none:
        yield id_, kind, error, None, None, None, None, None, None


def _chunk_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [kind, pa.string(), pa.string(), *[pa.int32()] * 5]
    xs = [r for r in columns[8] if r is not None]
    xy = np.concatenate(xs) if xs else np.zeros((0, 2))
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in columns[8])])
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, i])) for i in (0, 1)], names=["x", "y"])
    c = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points, mask=pa.array([r is None for r in columns[8]]))
    return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(columns[:8], types, strict=True)), c], names=["id", "kind", "error", "part", "ring", "first", "n", "w", "c"])


def _chunked(df: DataFrame, id: str, column: str, parse, size: int) -> DataFrame:  # noqa: ANN001, A002
    name = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, vertices = [], 0
            for i in range(b.num_rows):
                for row in _chunks_of(b.column(0)[i].as_py(), b.column(1)[i].as_py(), parse, size):
                    rows.append(row)
                    vertices += 1 if row[8] is None else len(row[8])
                    if vertices >= BATCH:
                        yield _chunk_batch(rows, b.column(0).type)
                        rows, vertices = [], 0
            if rows:
                yield _chunk_batch(rows, b.column(0).type)

    return df.select(F.col(id).alias("id"), F.col(column)).mapInArrow(run, f"id {name}, {CHUNKS}")


def chunks_from_wkb(df: DataFrame, id: str = "id", wkb: str = "wkb", size: int = CHUNK) -> DataFrame:  # noqa: A002
    """Vertex chunks of each row's geometry, so that no row grows with it; the turn of a ring is found here, where the ring is whole. A null, empty or broken geometry keeps one row."""
    return _chunked(df, id, wkb, parse_wkb, size)


def chunks_from_wkt(df: DataFrame, id: str = "id", wkt: str = "wkt", size: int = CHUNK) -> DataFrame:  # noqa: A002
    """As :func:`chunks_from_wkb`, from text."""
    return _chunked(df, id, wkt, parse_wkt, size)


def as_wkb_list(values: object) -> list[bytes | None]:
    """WKB of bytes, of objects with ``to_wkb`` or ``wkb`` (shapely, geopandas), or of a sequence of these and None."""
    if isinstance(values, (bytes, bytearray, memoryview)):
        return [bytes(values)]
    geometry = getattr(values, "geometry", None)
    if geometry is not None and hasattr(geometry, "to_wkb"):
        values = geometry
    if hasattr(values, "to_wkb"):
        return [None if v is None else bytes(v) for v in values.to_wkb()]
    if hasattr(values, "wkb"):
        return [bytes(values.wkb)]
    if isinstance(values, str) or not isinstance(values, Iterable):
        raise TypeError(f"cannot interpret {type(values).__name__} as geometries")
    out: list[bytes | None] = []
    for v in values:
        if v is None:
            out.append(None)
        elif isinstance(v, (bytes, bytearray, memoryview)):
            out.append(bytes(v))
        elif hasattr(v, "wkb"):
            out.append(bytes(v.wkb))
        else:
            raise TypeError(f"cannot interpret {type(v).__name__} as a geometry")
    return out


def from_sequence(spark: SparkSession, values: object) -> DataFrame:
    """id (1-based position) and wkb of an in-memory sequence."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(as_wkb_list(values), 1)], "id int, wkb binary")


def read_fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, quoted fields and NA for null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA")

"""A burn of each geometry inside its own row, over Arrow batches: no exchange and no state, so streams of polygons and lines
are burnt in append mode.

What a row costs is what its geometry crosses. For batches :func:`meshwright.operators.burn.burn` is the better way, as it spreads
one geometry over tasks; both give the same entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.polygons import TOLERANCE
from meshwright.plans.grid import Grid
from meshwright.sources.wkb import GeometryError, parse_wkb, turn

ENTRIES = "rank int, row int, col_start int, col_end int, measure double"
_EMPTY = np.zeros(0, np.int64)


def _between(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, its index and all whole numbers from low to high."""
    many = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(low)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]


def _steps(rings: list[tuple[np.ndarray, int]], grid: Grid) -> np.ndarray:
    """u0, v0, u1, v1 (in cells, v downward), the weight and the length of all segments."""
    out = [np.zeros((6, 0))]
    for c, w in rings:
        u, v = (c[:, 0] - grid.xmin) / grid.dx, (grid.ymax - c[:, 1]) / grid.dy
        out.append(np.array([u[:-1], v[:-1], u[1:], v[1:], np.full(len(c) - 1, w), np.hypot(*np.diff(c, axis=0).T)]))
    return np.concatenate(out, 1)


def _cut(s: np.ndarray, grid: Grid, beside: bool) -> tuple[np.ndarray, ...]:
    """Segment, row, col, t0, t1 of the pieces of segments; columns beside the grid are -1 or ncol, or left out."""
    u0, v0, u1, v1 = s[:4]
    flat, low, high = v0 == v1, np.minimum(v0, v1), np.maximum(v0, v1)
    first = np.where(flat & (low == grid.nrow), grid.nrow - 1, np.floor(low))
    last = np.where(flat, first, np.ceil(high) - 1)
    bounded = lambda a, lo, hi: np.clip(a, lo, hi).astype(np.int64)
    of, row = _between(bounded(first, 0, grid.nrow), bounded(last, -1, grid.nrow - 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        one, two = (row - v0[of]) / (v1 - v0)[of], (row + 1 - v0[of]) / (v1 - v0)[of]
        ta, tb = np.where(flat[of], 0.0, np.maximum(0.0, np.minimum(one, two))), np.where(flat[of], 1.0, np.minimum(1.0, np.maximum(one, two)))
        kept = ta < tb
        of, row, ta, tb = of[kept], row[kept], ta[kept], tb[kept]
        du = (u1 - u0)[of]
        left, right = np.minimum(u0[of] + ta * du, u0[of] + tb * du), np.maximum(u0[of] + ta * du, u0[of] + tb * du)
        upright = du == 0
        lo = np.where(upright & (left == grid.ncol) & (not beside), grid.ncol - 1, np.floor(left))
        hi = np.where(upright, lo, np.maximum(lo, np.ceil(right) - 1))
        if beside:
            lo, hi = bounded(lo, -1, grid.ncol), bounded(hi, -1, grid.ncol)
        else:
            lo, hi = bounded(lo, 0, grid.ncol), bounded(hi, -1, grid.ncol - 1)
        at, col = _between(lo, hi)
        of, row, ta, tb, du, upright = of[at], row[at], ta[at], tb[at], du[at], upright[at]
        one, two = (col - u0[of]) / du, (col + 1 - u0[of]) / du
        into, out = np.minimum(one, two), np.maximum(one, two)
        if beside:  # the columns beside the grid reach to infinity
            into = np.where(((col == -1) & (du > 0)) | ((col == grid.ncol) & (du < 0)), -np.inf, into)
            out = np.where(((col == -1) & (du < 0)) | ((col == grid.ncol) & (du > 0)), np.inf, out)
        t0, t1 = np.where(upright, ta, np.maximum(ta, into)), np.where(upright, tb, np.minimum(tb, out))
    kept = t0 < t1
    return of[kept], row[kept], col[kept], t0[kept], t1[kept]


def _summed(row: np.ndarray, col: np.ndarray, width: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (row, col) in order, and the sums of values there. col is -1 at least and width - 2 at most."""
    key, at = np.unique(row * width + col + 1, return_inverse=True)
    return key // width, key % width - 1, *(np.bincount(at, v, len(key)) for v in values)


def _running(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The running sum of values inside each row."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    total = np.cumsum(value)
    return total - np.repeat(total[starts] - value[starts], np.diff(np.append(starts, len(row))))


def _nexts(row: np.ndarray, col: np.ndarray, ncol: int) -> np.ndarray:
    """The next column in the same row, or ncol."""
    return np.where(np.append(row[1:], -1) == row, np.append(col[1:], ncol), ncol) if len(row) else _EMPTY


def polygon_coverage(rings: list[tuple[np.ndarray, int]], grid: Grid) -> tuple[np.ndarray, ...]:
    """row, col_start, col_end, share (0-based) of one part: boundary cells, and the gaps between them."""
    s = _steps(rings, grid)
    s = s[:, (s[1] != s[3]) & (np.minimum(s[0], s[2]) <= grid.ncol)]
    of, row, col, t0, t1 = _cut(s, grid, beside=True)
    u0, v0, u1, v1, w, _ = s[:, of]
    cover = w * (v1 - v0) * (t1 - t0)
    middle = u0 + (u1 - u0) * (t0 + t1) / 2
    row, col, cover, area = _summed(row, col, grid.ncol + 2, cover, cover * np.where(col < 0, 1.0, np.where(col >= grid.ncol, 0.0, 1 - (middle - col))))
    after = _running(row, cover)
    a, b = np.concatenate([col, col + 1]), np.concatenate([col, np.minimum(_nexts(row, col, grid.ncol), grid.ncol) - 1])
    row, share = np.concatenate([row, row]), np.concatenate([after - cover + area, after])
    kept = (a <= b) & (a >= 0) & (b < grid.ncol) & (share > TOLERANCE)
    return row[kept], a[kept], b[kept], np.where(share[kept] >= 1 - TOLERANCE, 1.0, share[kept])


def polygon_centres(rings: list[tuple[np.ndarray, int]], grid: Grid) -> tuple[np.ndarray, ...]:
    """row, col_start, col_end, share (1) of the cells of one part whose centres are inside."""
    out = [np.zeros((3, 0))]
    for c, w in rings:
        x0, y0, x1, y1 = *c[:-1].T, *c[1:].T
        at = lambda y: np.ceil((grid.ymax - y) / grid.dy - 0.5 - 1e-10)
        use = (y0 != y1) & (np.minimum(x0, x1) <= grid.xmax)
        low, high = np.where(use, np.clip(at(np.maximum(y0, y1)), 0, grid.nrow), 1), np.where(use, np.clip(at(np.minimum(y0, y1)) - 1, -1, grid.nrow - 1), 0)
        of, row = _between(low.astype(np.int64), high.astype(np.int64))
        y = grid.ymax - (row + 0.5) * grid.dy
        x = x0[of] + (y - y0[of]) / (y1 - y0)[of] * (x1 - x0)[of]
        near = np.clip(np.floor((x - grid.xmin) / grid.dx), -1, grid.ncol)
        begins = np.clip(np.where(x <= grid.xmin + (near + 0.5) * grid.dx, near, near + 1), 0, grid.ncol)
        out.append(np.array([row, begins, w * np.where(y0[of] >= y, -1, 1)]))
    row, col, down = np.concatenate(out, 1)
    row, col, down = _summed(row.astype(np.int64), col.astype(np.int64), grid.ncol + 2, down)
    winding = _running(row, down)
    start, end = col, _nexts(row, col, grid.ncol) - 1
    kept = (winding != 0) & (start <= end)
    return row[kept], start[kept], end[kept], np.ones(int(kept.sum()))


def line_pieces(line: np.ndarray, grid: Grid) -> tuple[np.ndarray, ...]:
    """row, col, col, length (0-based) of one line."""
    s = _steps([(line, 0)], grid)
    of, row, col, t0, t1 = _cut(s, grid, beside=False)
    row, col, length = _summed(row, col, grid.ncol + 2, s[5][of] * (t1 - t0))
    kept = length > 0
    return row[kept], col[kept], col[kept], length[kept]


def point_cell(xy: np.ndarray, grid: Grid) -> tuple[np.ndarray, ...]:
    """row, col, col, 1 (0-based) of the points on the extent."""
    x, y = xy.T
    kept = (x >= grid.xmin) & (x <= grid.xmax) & (y >= grid.ymin) & (y <= grid.ymax)
    col = np.minimum(np.floor((x[kept] - grid.xmin) / grid.dx), grid.ncol - 1).astype(np.int64)
    row = np.minimum(np.floor((grid.ymax - y[kept]) / grid.dy), grid.nrow - 1).astype(np.int64)
    return row, col, col, np.ones(len(row))


def entries(data: bytes | None, grid: Grid, mode: str) -> Iterator[tuple[np.ndarray, ...]]:
    """rank, row, col_start, col_end, measure (1-based) of each part of WKB; nothing of what can't be read, like a null."""
    try:
        kind, parts = parse_wkb(data) if data else (None, [])
    except GeometryError:
        return
    for part in parts:
        if kind == "polygon":
            rings = [(c, turn(c) * (1 if k == 0 else -1)) for k, c in enumerate(part) if len(c) >= 4] if part and len(part[0]) >= 4 else []
            row, a, b, m = (polygon_coverage if mode == "coverage" else polygon_centres)(rings, grid)
            rank = np.where(m == 1, 0, 1)
        else:
            row, a, b, m = line_pieces(part[0], grid) if kind == "line" else point_cell(part[0], grid)
            rank = np.full(len(row), 2 if kind == "line" else 3)
        yield rank, row + 1, a + 1, b + 1, m


def stream_burn(df: DataFrame, grid: Grid, mode: str = "coverage", id: str = "id", wkb: str = "wkb") -> DataFrame:  # noqa: A002
    """rank (runs, edges, lines, points), row, col_start, col_end, measure, id of WKB geometries, each burnt in its own row. df may be a stream."""
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for rank, row, a, c, m in entries(b.column(1)[i].as_py(), grid, mode):
                    if len(row):
                        ints = [pa.array(v.astype(np.int32)) for v in (rank, row, a, c)]
                        yield pa.RecordBatch.from_arrays([*ints, pa.array(m), pa.repeat(b.column(0)[i], len(row))], names=["rank", "row", "col_start", "col_end", "measure", "id"])

    return df.select(F.col(id).alias("id"), F.col(wkb)).mapInArrow(run, f"{ENTRIES}, id {kind}")

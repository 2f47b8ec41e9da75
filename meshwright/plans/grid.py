"""Regular grids: what the driver knows about a grid, as literals for expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """An axis-aligned grid; row 1 is at ymax, indices are 1-based."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    ncol: int
    nrow: int

    def __post_init__(self) -> None:
        if not (self.xmax > self.xmin and self.ymax > self.ymin):
            raise ValueError(f"the extent is empty or upside down: {self.bounds}")
        if not (self.ncol > 0 and self.nrow > 0):
            raise ValueError(f"grid dimensions must be positive: {self.shape}")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.xmin, self.ymin, self.xmax, self.ymax

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrow, self.ncol

    @property
    def dx(self) -> float:
        return (self.xmax - self.xmin) / self.ncol

    @property
    def dy(self) -> float:
        return (self.ymax - self.ymin) / self.nrow

    @property
    def cell_area(self) -> float:
        return self.dx * self.dy

    def transform(self) -> tuple[float, float, float, float, float, float]:
        """The affine tuple of raster tools."""
        return self.dx, 0.0, self.xmin, 0.0, -self.dy, self.ymax

    def cell_box(self, row: int, col: int) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax of a cell; the last row and column end at the extent."""
        right = self.xmax if col == self.ncol else self.xmin + col * self.dx
        bottom = self.ymin if row == self.nrow else self.ymax - row * self.dy
        return self.xmin + (col - 1) * self.dx, bottom, right, self.ymax - (row - 1) * self.dy

    def window(self, xmin: float, ymin: float, xmax: float, ymax: float, eps: float = 1e-8) -> tuple[int, int, int, int] | None:
        """First and last row and column of the cells that a box touches, snapped outward; None if there are none."""
        col_lo, col_hi = max(1, math.floor((xmin - self.xmin) / self.dx + eps) + 1), min(self.ncol, math.ceil((xmax - self.xmin) / self.dx - eps))
        row_lo, row_hi = max(1, math.floor((self.ymax - ymax) / self.dy + eps) + 1), min(self.nrow, math.ceil((self.ymax - ymin) / self.dy - eps))
        return (row_lo, row_hi, col_lo, col_hi) if col_lo <= col_hi and row_lo <= row_hi else None

    def sub(self, row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> Grid:
        """The grid of a window of cells."""
        return Grid(
            self.xmin + (col_lo - 1) * self.dx, self.ymax - row_hi * self.dy, self.xmin + col_hi * self.dx, self.ymax - (row_lo - 1) * self.dy, col_hi - col_lo + 1, row_hi - row_lo + 1
        )

    def shrink_to(self, xmin: float, ymin: float, xmax: float, ymax: float) -> Grid:
        """The smallest aligned grid that holds the part of a box inside this grid."""
        found = self.window(xmin, ymin, xmax, ymax)
        if found is None:
            raise ValueError("the box and the grid's extent don't overlap")
        return self.sub(*found)

    def padded(self, cells: int = 1) -> Grid:
        """This grid with so many more rows and columns on each side, or fewer if ``cells`` is below zero."""
        x, y = cells * self.dx, cells * self.dy
        return Grid(self.xmin - x, self.ymin - y, self.xmax + x, self.ymax + y, self.ncol + 2 * cells, self.nrow + 2 * cells)

    def subdivide(self, size: int) -> Iterator[tuple[int, int, Grid]]:
        """(tile row, tile column, grid) of blocks of at most ``size`` cells a side."""
        for r in range(0, self.nrow, size):
            for c in range(0, self.ncol, size):
                yield r // size, c // size, self.sub(r + 1, min(self.nrow, r + size), c + 1, min(self.ncol, c + size))

    def compatible_with(self, other: Grid, tolerance: float = 1e-6) -> bool:
        """Whether both grids have the same cell size and their cells line up."""
        if abs(self.dx - other.dx) > tolerance * self.dx or abs(self.dy - other.dy) > tolerance * self.dy:
            return False
        off = lambda a, b, d: abs((a - b) / d - round((a - b) / d)) <= tolerance
        return off(self.xmin, other.xmin, self.dx) and off(self.ymax, other.ymax, self.dy)

    def _joined(self, other: Grid, box: tuple[float, float, float, float]) -> Grid:
        if not self.compatible_with(other):
            raise ValueError("the grids don't line up")
        x0, y0, x1, y1 = box
        return Grid(x0, y0, x1, y1, round((x1 - x0) / self.dx), round((y1 - y0) / self.dy))

    def common(self, other: Grid) -> Grid:
        """The grid that holds both of two aligned grids."""
        return self._joined(other, (min(self.xmin, other.xmin), min(self.ymin, other.ymin), max(self.xmax, other.xmax), max(self.ymax, other.ymax)))

    def overlap(self, other: Grid) -> Grid | None:
        """The grid of the cells that two aligned grids share, if there are any."""
        x0, y0, x1, y1 = max(self.xmin, other.xmin), max(self.ymin, other.ymin), min(self.xmax, other.xmax), min(self.ymax, other.ymax)
        return self._joined(other, (x0, y0, x1, y1)) if x1 - x0 > self.dx / 2 and y1 - y0 > self.dy / 2 else None

    def offsets(self, other: Grid) -> tuple[int, int]:
        """Rows and columns from this grid's first cell to that of an aligned grid inside it."""
        return round((self.ymax - other.ymax) / self.dy), round((other.xmin - self.xmin) / self.dx)


def extent_of(coordinates: DataFrame) -> tuple[float, float, float, float]:
    """The bounding box of finite coordinates (x, y). This is a job; nothing but four numbers reaches the driver."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    row = coordinates.agg(F.min(finite("x")).alias("x0"), F.min(finite("y")).alias("y0"), F.max(finite("x")).alias("x1"), F.max(finite("y")).alias("y1")).first()
    if row["x0"] is None or row["y0"] is None:
        raise ValueError("no extent: there are no coordinates")
    return row["x0"], row["y0"], row["x1"], row["y1"]


def resolve(bounds: tuple[float, float, float, float], shape: tuple[int, int] | None = None, resolution: float | tuple[float, float] | None = None, size: int = 256) -> Grid:
    """A grid from an extent and either a shape (rows, columns), a cell size, or neither (``size`` cells on the longer side)."""
    x0, y0, x1, y1 = map(float, bounds)
    if not (x1 > x0 and y1 > y0):
        raise ValueError(f"the extent is empty or upside down: {bounds}")
    if shape is not None and resolution is not None:
        raise ValueError("give shape or resolution, not both")
    if resolution is not None:
        dx, dy = resolution if isinstance(resolution, (tuple, list)) else (resolution, resolution)
        if not (dx > 0 and dy > 0):
            raise ValueError("resolution must be positive")
        shape = math.ceil((y1 - y0) / dy), math.ceil((x1 - x0) / dx)
    if shape is None:
        longer = max(x1 - x0, y1 - y0)
        shape = math.ceil(size * (y1 - y0) / longer), math.ceil(size * (x1 - x0) / longer)
    return Grid(x0, y0, x1, y1, int(shape[1]), int(shape[0]))

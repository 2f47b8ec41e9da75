"""Whitening of embeddings by a tiled covariance.

Vectors become whole numbers; each distinct one is fitted once. The fit list is written once and read in row-blocks. A
row-block, centred, is cut into column blocks of ``TILE`` dimensions, which are exchanged by row-block and meet in pairs: the
pair of two column blocks is a tile key, their product a part of that tile of the covariance. Each task adds up its parts
of a tile, a grouping adds up the tasks', and the driver gets nothing but the D x D sums (D: dimensions), which it
decomposes. All rows are then projected where they are.

Centring subtracts the nearest whole number to each mean, so products and sums of whole numbers are exact, and what the
mean lies beside it is taken off the sums exactly: n * sum(yi * yj) - sum(yi) * sum(yj), over n * n.

Defined results: vectors of the length that most rows have take part (of equally frequent lengths the longest); others are
left out, as are null vectors and vectors with null or non-finite entries. Repeated rows are whitened like others. At most
``COMPONENTS`` components are given, and only those of an eigenvalue above 1e-12 of the largest: constant dimensions have
no direction. With no row, or no spread at all, the result is empty. A row without an id keeps its null id. Signs make each
component's largest entry positive. A deviation beyond 64 bits ends the job with an error rather than wrapping. Further
columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import released, stored, table

COMPONENTS, TILE, ROWS = 16, 16, 4096
SCALE, OFFSET = 64, 1_000_000
#: Below this whole numbers and their sums are exact in doubles.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """True for vectors that have entries, none of them null or non-finite."""
    return (F.size(vector) > 0) & F.coalesce(~F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most rows' vectors have, the longest of several; 0 if there are none. Lengths are few, and one row comes back."""
    best = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return 0 if best is None else best["d"]


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x, the whole-number vector of every usable row."""
    x = F.transform(vector, lambda e: F.floor(F.lit(SCALE) * e.cast("double")) + OFFSET)
    return df.where(usable(vector)).select(F.col(key).alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in batches:
            x = matrix(b.column(0), dims)
            n += len(x)
            far = len(x) and float(abs(x).max()) * len(x) >= EXACT
            sums = [s + int(v) for s, v in zip(sums, (x.astype(object) if far else x).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"d": pa.array([-1, *range(dims)], pa.int32()), "s": pa.array([str(v) for v in (n, *sums)])})

    rows = fit.select("x").mapInArrow(run, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["d"]: int(r["s"]) for r in rows}  # one row a dimension
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def product(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The entries of transpose(a) times b, exactly."""
    most = float(abs(a).max(initial=0)) * float(abs(b).max(initial=0)) * len(a)
    if most < EXACT:
        return (a.T.astype(float) @ b.astype(float)).astype(np.int64).ravel().tolist()
    return (a.T.astype(object) @ b.astype(object)).ravel().tolist()


def column_blocks(fit: DataFrame, centre: list[int], tile: int) -> DataFrame:
    """row_block, col_block and the entries of centred rows, column after column."""
    dims, middle = len(centre), np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = matrix(b.column(0).slice(at, ROWS), dims) - middle
                starts = range(0, dims, tile)
                parts = [np.ascontiguousarray(y[:, s : s + tile].T).astype("<i8").tobytes() for s in starts]
                yield pa.RecordBatch.from_pydict({"row_block": pa.array([number] * len(parts), pa.int64()), "col_block": pa.array(range(len(parts)), pa.int32()), "entries": pa.array(parts, pa.binary())})
                number += 1

    return fit.select("x").mapInArrow(run, "row_block long, col_block int, entries binary")


def tile_sums(blocks: DataFrame, dims: int, tile: int) -> np.ndarray:
    """The sums over rows of the products of each two dimensions, as whole numbers, from column blocks of centred rows."""
    width = lambda k: min(tile, dims - k * tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}  # of this task: one entry a tile
        for b in batches:
            for i, j, left, right in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                one, two = (np.frombuffer(e, "<i8").reshape(width(k), -1).T for k, e in ((i, left), (j, right)))
                found = product(one, two)
                sums[i, j] = [s + v for s, v in zip(sums[i, j], found, strict=True)] if (i, j) in sums else found
        for (i, j), values in sums.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "sums": pa.array([[str(v) for v in values]], pa.list_(pa.string()))})

    one = blocks.select("row_block", F.col("col_block").alias("i"), F.col("entries").alias("left"))
    two = blocks.select("row_block", F.col("col_block").alias("j"), F.col("entries").alias("right"))
    pairs = one.join(two, "row_block").where("i <= j").select("i", "j", "left", "right")
    parts = pairs.mapInArrow(run, "i int, j int, sums array<string>").select("i", "j", F.posexplode("sums").alias("at", "s"))
    summed = parts.groupBy("i", "j", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((dims, dims), object)
    for r in summed.toLocalIterator():  # half of D x D numbers
        a, b = r["i"] * tile + r["at"] // width(r["j"]), r["j"] * tile + r["at"] % width(r["j"])
        out[a, b] = out[b, a] = int(r["s"])
    return out


def decomposed(products: np.ndarray, n: int, rest: list[int], components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors (as columns) and the trace of the covariance. rest: sums of the centred entries."""
    dims = len(rest)
    v = np.array([[float((n * products[a, b] - rest[a] * rest[b])) / (float(n) * n) for b in range(dims)] for a in range(dims)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > 1e-12 * max(values[0], 0)).sum())) if values[0] > 0 else 0
    vectors = vectors[:, :keep]
    vectors = vectors * np.sign(vectors[abs(vectors).argmax(0), np.arange(keep)])
    return values[:keep], vectors, float(np.trace(v))


def identity_error(fit: DataFrame, middle: np.ndarray, beside: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the covariance of whitened fit rows less the identity, measured on the rows: a row a task, then K x K sums."""
    dims, k = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k + 1, k)), 0
        for b in batches:
            w = (matrix(b.column(0), dims) - middle - beside) @ turn
            total += np.vstack([w.T @ w, w.sum(0)])
            n += len(w)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size + 1), pa.int32()), "s": pa.array([*total.ravel(), float(n)], pa.float64())})

    rows = fit.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    flat = np.array([r["s"] for r in sorted(rows, key=lambda r: r["at"])])
    total, n = flat[:-1].reshape(k + 1, k), flat[-1]
    mean = total[k] / n
    return float(abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row."""
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(df, key, vector)
    dims = common_length(rows, "x")
    rows = rows.where(F.size("x") == dims)
    fit = stored(rows.select("x").distinct())
    n, sums = moments(fit, dims)
    if not n or not dims:
        return df.sparkSession.createDataFrame([], result)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    blocks = stored(column_blocks(fit, centre, tile))
    values, vectors, trace = decomposed(tile_sums(blocks, dims, tile), n, rest, components)
    released(blocks)
    if not len(values):
        released(fit)
        return df.sparkSession.createDataFrame([], result)
    middle, beside = np.array(centre, np.int64), np.array([r / n for r in rest])
    turn = vectors / np.sqrt(values)
    error = identity_error(fit, middle, beside, turn)
    released(fit)
    many, explained = len(values), (values / trace).tolist()
    left = np.array(rest, object if max(map(abs, rest)) >= EXACT else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                y = matrix(part.column(1), dims) - middle
                m = len(y)
                # n * x - S is n * y less what the sums have beside the centre
                if (float(abs(y).max(initial=0)) * n + float(abs(left).max())) ** 2 * dims < 2**62:
                    deviation = ((n * y - left) ** 2).sum(1)
                else:
                    deviation = [int(((n * r - left.astype(object)) ** 2).sum()) for r in y.astype(object)]
                w = (y - beside) @ turn
                repeated = lambda v, kind: pa.array(np.repeat(np.asarray(v), many), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), many))), pa.array(np.tile(np.arange(1, many + 1), m), pa.int32()), pa.array(np.full(m * many, n), pa.int64()),
                        repeated(deviation, pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * many, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, result)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))

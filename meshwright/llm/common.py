"""What the corpus operators share: table access, learning splits, scratch tables and vectorised byte-level text work.

Text conventions used everywhere in this subpackage: a null text counts as the empty text, a word is a maximal run of
bytes outside ``0x09-0x0D`` and ``0x20`` of the UTF-8 text, and no text is ever cut to a prefix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer single text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read by Spark only, so any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)).cast("int")


def held_out(column: str, modulus: int, value: int) -> Column:
    """True for rows that a model must not learn from. Rows without an id are never learnt from."""
    return F.coalesce(remainder(column, modulus) == value, F.lit(True))


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a session without that setting gets one inside its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    return f"{base.rstrip('/')}/mw-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Deletes the files of tables made by :func:`stored` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with these, and that ``df`` has none of (letter case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, empty for nulls."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def per_text(
    df: DataFrame, key: str, text: str, schema: str, step: Callable[[list, list[bytes]], dict[str, Iterable]], step_bytes: int = STEP_BYTES
) -> DataFrame:
    """Apply ``step`` to (keys, texts) of bounded size and return its columns; only one step's texts become Python objects at a time."""
    names, arrow = None, None
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow, names = to_arrow_schema(kind), kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, step_bytes, 1):
                out = step(part.column(0).to_pylist(), as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, kind)


def parts(batch: pa.RecordBatch, step_bytes: int, *columns: int | pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts, in the given columns, have at most ``step_bytes`` bytes together, or of one row; nothing is copied."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c) if isinstance(c, int) else c), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step_bytes, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(texts: list[bytes], step_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``step_bytes`` bytes, or of one text."""
    lo = total = 0
    for i, x in enumerate(texts):
        if i > lo and total + len(x) > step_bytes:
            yield lo, i
            lo, total = i, 0
        total += len(x)
    if lo < len(texts):
        yield lo, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, STEP_BYTES + 65536)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (published as splitmix64), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """All words of some texts at once: bytes, word bounds, a 64-bit hash of each word, and each word's text."""

    def __init__(self, texts: list[bytes], hashes: bool = True):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        word = ~_SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text's words; one more at the end
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.bytes) + 1)
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every ``n`` consecutive words of one text, and the index of its first word."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(len(self.hash) - n + 1, np.uint64)
        for k in range(n):
            h = h * _ODD + self.hash[k : k + len(h)]
        at = np.flatnonzero(self.text[: len(h)] == self.text[n - 1 :])
        return mix(h[at]), at

"""Cost-balanced packing of tokenised documents into sequences of bounded length.

Each piece of ``n`` tokens costs ``linear * n + quadratic * n * n``. Documents longer than a sequence give whole
sequences of their own and one remainder. Pieces then go, in descending length, to the cheapest sequence that still has
room for all of the piece; where none has, the piece is cut and fills the cheapest sequences with any room. A block holds
as many sequences as its tokens fill completely, so nothing is padded; tokens over (less than one sequence) move to the
next block, and at the end of a partition they go to sequences whose lengths are the powers of two that sum to them.

A partition is read once, in blocks of ``BLOCK`` sequences, and no rows are exchanged. A task that runs again over the
same rows gives the same sequences. Sequence ids hold the partition number in their high bits.

Defined results: a null or empty text is one piece that holds the end id; a very long text is cut like any other; equal
texts are separate documents; ties in length are settled by order of arrival and ties in cost by the lower sequence; a
null id is kept as null; an empty table gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshwright.llm.common import as_bytes, table

SEQUENCE, BLOCK, END_ID = 2048, 256, 1
#: Words up to this length are kept with their ids, up to so many; others are tokenised each time.
CACHED_BYTES, CACHED_WORDS = 64, 700_000
_TAILED = re.compile(rb"([a-z\x80-\xff]+)([^a-z0-9'\x80-\xff]+)", re.S)


def default_tokenizer() -> str:
    """The place of the public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of each word, as little-endian 16-bit numbers.

    The vocabulary drops white space and letter case and never joins letters with punctuation or across white space, so
    words can be taken one by one in lower case, and a word of letters with ASCII punctuation behind it in two parts.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.array(END_ID, self.kind)

    def encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        parts = _TAILED.fullmatch(word)
        if parts and (parts[1][-1] < 0x80 or parts[1].decode("utf-8", "replace")[-1].lower()[-1].isalpha()):
            ids = self[parts[1]] + self[parts[2]]
        else:
            ids = self.encode(word)
        if len(word) <= CACHED_BYTES and len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> np.ndarray:
        """The ids of a whole text."""
        if b"<|" in text:  # perhaps a special token's string, whose case matters
            return np.frombuffer(self.encode(text), self.kind)
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), self.kind)


_loaded: dict[str | None, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    """The tokenizer of this Python worker, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Packer:
    """Packs the pieces of one partition. A piece is [document, start, ids]; a document is (id, tokens)."""

    def __init__(self, sequence: int, block: int, linear: float, quadratic: float, first_id: int):
        self.sequence, self.block, self.linear, self.quadratic = sequence, block, linear, quadratic
        self.next_id, self.waiting, self.tokens = first_id, [], 0
        self.rows: list[tuple] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """One document, its end id included."""
        document, whole = (key, len(ids)), len(ids) // self.sequence * self.sequence
        for start in range(0, whole, self.sequence):
            self._place(document, start, ids[start : start + self.sequence], self._new(), 0)
        if whole < len(ids):
            self.waiting.append((document, whole, ids[whole:]))
            self.tokens += len(ids) - whole
            if self.tokens >= self.block * self.sequence:
                self.pack()

    def _new(self, n: int = 1) -> int:
        self.next_id += n
        return self.next_id - n

    def _place(self, document: tuple, start: int, ids: np.ndarray, sequence: int, offset: int) -> None:
        self.rows.append((document[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), document[1], sequence, offset))

    def _fill(self, pieces: list[tuple], sizes: np.ndarray) -> list[tuple]:
        """Place pieces in sequences of these sizes, which end up full; what is left over comes back."""
        first = self._new(len(sizes))
        room, cost, over = sizes.astype(np.int64), np.zeros(len(sizes)), []
        for document, start, ids in sorted(pieces, key=lambda p: -len(p[2])):
            while len(ids):
                fits = room >= len(ids)
                open_ = fits if fits.any() else room > 0
                if not open_.any():
                    over.append((document, start, ids))
                    break
                k = int(np.where(open_, cost, np.inf).argmin())
                n = min(len(ids), int(room[k]))
                self._place(document, start, ids[:n], first + k, int(sizes[k] - room[k]))
                room[k] -= n
                cost[k] += self.linear * n + self.quadratic * n * n
                start, ids = start + n, ids[n:]
        return over

    def pack(self) -> None:
        """Fill as many whole sequences as the waiting pieces do."""
        if n := self.tokens // self.sequence:
            self.waiting = self._fill(self.waiting, np.full(n, self.sequence))
            self.tokens -= n * self.sequence

    def finish(self) -> None:
        self.pack()
        if self.tokens:
            self._fill(self.waiting, np.array([1 << b for b in range(self.tokens.bit_length() - 1, -1, -1) if self.tokens >> b & 1]))
        self.waiting, self.tokens = [], 0

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    sequence: int = SEQUENCE, block: int = BLOCK, linear: float = 1.0, quadratic: float = 1 / 1024,
) -> DataFrame:
    """The pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = (key, *COLUMNS)
    kind = StructType([StructField(n, LongType()) for n in names])
    arrow = pa.schema([(n, pa.int64()) for n in names])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer), Packer(sequence, block, linear, quadratic, TaskContext.get().partitionId() << 40)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                packer.add(k, np.append(words.of(t), words.end))
                if len(packer.rows) >= 4096:
                    yield batch(packer.drain())
        packer.finish()
        if packer.rows:
            yield batch(packer.drain())

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, kind)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

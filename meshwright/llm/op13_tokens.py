"""Token counts of whole texts without token ids: pieces are counted once for each distinct pre-token of the corpus.

Documents are read in blocks of about ``BLOCK_BYTES``. Each block becomes one stored row: its distinct pre-tokens, and for
each document which of them it has and how often. The pre-tokens of all blocks are exchanged by their text, so that each
distinct one is split into pieces once, and the numbers of pieces go back to the blocks that have it. There they meet the
frequencies, and each document's sum is taken. A very frequent pre-token has one row a block, not one a document.

The pre-tokenizer is the vocabulary's own (byte level). White space and what follows it can be told apart before it is
asked: a text may be cut before a space or a line break, unless that lies inside a run of three or more white-space
characters, or of two at the end; texts with such runs are given to the library whole. Cut units are distinct far less
often than they occur, so the library sees each of a block once.

Defined results: a null or empty text has no bytes and no tokens; the special string inside a text is one token, as the
library's default has it; a very long text is a block of its own; equal texts have equal counts; repeated rows and rows
without an id are rows like others; an empty table gives no rows; further columns are ignored, whatever their names are.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import as_bytes, spans, stored, table

LIMIT, BLOCK_BYTES, SLICE_ROWS, STEP_PAIRS = 1024, 16 << 20, 256, 200_000
SPECIAL = b"<|endoftext|>"
#: Bytes that may end a white-space character, and bytes that may begin one.
_ENDS, _BEGINS = rb"\x09-\x0d\x1c-\x20\x80-\x8a\x9f\xa0\xa8\xa9\xaf", rb"\x09-\x0d\x1c-\x20\xc2\xe1\xe2\xe3"
_RUN = re.compile(rb"[" + _ENDS + rb"][ \n](?:[" + _BEGINS + rb"]|\Z)")
#: A unit of Latin letters or digits, perhaps behind a line break or a space and opening punctuation, with punctuation behind it: each
#: group is a pre-token. The apostrophe is left to the library.
_LATIN, _MARKS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+", rb"[!-&(-/:-@\[-`{-~]"
_PLAIN = re.compile(rb"(\n?)((?: ?" + _MARKS + rb"+)?)((?:(?<!" + _MARKS + rb") )?(?:" + _LATIN + rb"|[0-9]+))(" + _MARKS + rb"*)")
STORED = "block long, words array<string>, ids array<long>, n_bytes array<long>, sizes array<int>, codes binary, counts binary"


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


_ALPHABET = dict(enumerate(byte_alphabet()))


def written(raw: bytes) -> bytes:
    """Bytes of letters, digits, marks, spaces and line breaks in the vocabulary's byte alphabet, as UTF-8."""
    if raw.isascii():  # all printable but these two
        return raw.replace(b" ", b"\xc4\xa0").replace(b"\n", b"\xc4\x8a")
    return raw.decode("latin-1").translate(_ALPHABET).encode()


def default_tokenizer() -> str:
    """The place of the public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_loaded: dict = {}


def tokenizer(path: str | None):  # noqa: ANN201
    """The tokenizer of this Python worker, loaded once."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path or default_tokenizer())
    return _loaded[path]


class Block:
    """Pre-tokens (in the vocabulary's byte alphabet) of some documents, numbered, and each document's frequencies."""

    def __init__(self, split):  # noqa: ANN001
        self.split = split
        self.words: dict[bytes, int] = {}
        self.units: dict[bytes, int] = {}
        self.of_units: list[int] = []  # numbers of the pre-tokens of all units, one unit after another
        self.unit_ends: list[int] = [0]
        self.ids, self.n_bytes, self.pairs, self.waiting = [], [], [], 0
        self.codes, self.counts, self.sizes = [], [], []

    def _unit(self, key: bytes, texts: Iterable[bytes]) -> int:
        """The number of a unit that wasn't met before, from its pre-tokens."""
        self.of_units += [self.words.setdefault(t, len(self.words)) for t in texts]
        self.unit_ends.append(len(self.of_units))
        return self.units.setdefault(key, len(self.units))

    def _pretokens(self, raw: bytes) -> list[bytes]:
        if plain := _PLAIN.fullmatch(raw):
            return [written(g) for g in plain.groups() if g]
        return [w.encode() for w, _ in self.split(raw.decode("utf-8", "replace"))]

    def add(self, key: int | None, text: bytes) -> None:
        """One document. Units are kept by what follows the space they were cut at; a first unit by its text behind one space, a single pre-token by its text behind two."""
        counts: Counter = Counter()
        parts = text.split(SPECIAL)
        alone = Counter({SPECIAL: len(parts) - 1}) if len(parts) > 1 else Counter()
        for part in parts:
            if _RUN.search(part):
                alone.update(self._pretokens(part))
                continue
            first, *rest = part.replace(b"\n", b" \n").split(b" ")
            if first:
                k = self.units.get(b" " + first)
                counts[self._unit(b" " + first, self._pretokens(first)) if k is None else k] += 1
            for u, n in Counter(rest).items():
                k = self.units.get(u)
                counts[self._unit(u, self._pretokens(u if u[:1] == b"\n" else b" " + u)) if k is None else k] += n
        for w, n in alone.items():
            name = b"  " + w
            k = self.units.get(name)
            counts[self._unit(name, [w]) if k is None else k] += n
        self.ids.append(key)
        self.n_bytes.append(len(text))
        self.pairs.append((np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
        self.waiting += len(counts)
        if self.waiting >= STEP_PAIRS:
            self.settle()

    def settle(self) -> None:
        """Turns units of the documents since the last call into pre-tokens, each once a document, in ascending order; then units are forgotten, so that only pre-tokens are held."""
        if not self.pairs:
            return
        ends, of = np.array(self.unit_ends), np.array(self.of_units, np.int64)
        unit = np.concatenate([u for u, _ in self.pairs])
        times = np.concatenate([n for _, n in self.pairs])
        document = np.repeat(np.arange(len(self.pairs)), [len(u) for u, _ in self.pairs])
        many = ends[unit + 1] - ends[unit]
        at = np.repeat(ends[unit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        key, place = np.unique(np.repeat(document, many) * np.int64(1 << 32) + of[at], return_inverse=True)
        self.codes.append((key & 0xFFFFFFFF).astype(np.int32))
        self.counts.append(np.bincount(place, np.repeat(times, many), len(key)).astype(np.int64))
        self.sizes.append(np.bincount(key >> 32, minlength=len(self.pairs)))
        self.pairs, self.waiting = [], 0
        self.units, self.of_units, self.unit_ends = {}, [], [0]

    def row(self, number: int) -> pa.RecordBatch:
        """The stored row: sizes has how many pairs each document has; codes are differences of the numbers of pre-tokens, document after document."""
        self.settle()
        codes, counts, sizes = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (self.codes, self.counts, self.sizes))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), one(list(self.words), pa.string()), one(self.ids, pa.int64()), one(self.n_bytes, pa.int64()), one(sizes, pa.int32()),
                pa.array([packed(np.diff(codes.astype(np.int64), prepend=0))], pa.binary()), pa.array([packed(counts)], pa.binary()),
            ],
            names=["block", "words", "ids", "n_bytes", "sizes", "codes", "counts"],
        )


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes."""
    import zstandard

    kind = np.int32 if len(numbers) == 0 or (abs(numbers) < 1 << 31).all() else np.int64
    planes = numbers.astype(kind).view(np.uint8).reshape(len(numbers), np.dtype(kind).itemsize).T.tobytes()
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of :func:`packed`, as 64-bit ones."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = planes.reshape(data[0], len(planes) // data[0])
    return np.ascontiguousarray(planes.T).view(f"i{data[0]}").ravel().astype(np.int64)


def frequencies(df: DataFrame, key: str, text: str, path: str | None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents, see :class:`Block`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = tokenizer(path).pre_tokenizer.pre_tokenize_str, TaskContext.get().partitionId() << 32
        block, size = Block(split), 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                keys, texts = part.column(0).to_pylist(), as_bytes(part.column(1))
                for lo, hi in spans(texts, block_bytes):
                    more = sum(map(len, texts[lo:hi]))
                    if block.ids and size + more > block_bytes:
                        yield block.row(number)
                        block, size, number = Block(split), 0, number + 1
                    for k, t in zip(keys[lo:hi], texts[lo:hi], strict=True):
                        block.add(k, t)
                    size += more
        if block.ids:
            yield block.row(number)

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, STORED)


def piece_counts(words: DataFrame, path: str | None) -> DataFrame:
    """block, codes, pieces of the pre-tokens of all blocks (block, code, word). They come sorted, so each distinct one is split once; those of a block that are met together share a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last, n = tokenizer(path).model.tokenize, None, 0
        for b in batches:
            out = []
            for w in b.column("word").to_pylist():
                if w != last:
                    last, n = w, 1 if w == SPECIAL.decode() else len(split(w))
                out.append(n)
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            ends = pa.array([*starts, len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[order], pa.int32())) for v in (b.column("code").to_numpy(), np.array(out))]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][starts]), *lists], names=["block", "codes", "pieces"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, codes array<int>, pieces array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every document."""
    blocks = stored(frequencies(df, key, text, tokenizer_path))
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    counted_pieces = piece_counts(words, tokenizer_path)
    result = f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean"

    def summed(block: pa.Table, counted: pa.Table) -> pa.Table:
        numbers, pieces = (counted[c].combine_chunks().flatten().to_numpy() for c in ("codes", "pieces"))
        of = np.zeros(len(numbers), np.int64)
        of[numbers] = pieces
        (row,) = block.to_pylist()  # one block
        codes, counts, sizes = np.cumsum(unpacked(row["codes"])), unpacked(row["counts"]), np.array(row["sizes"], np.int64)
        total = np.concatenate([[0], np.cumsum(of[codes] * counts)])
        ends = np.cumsum(sizes)
        tokens = total[ends] - total[ends - sizes]
        return pa.table({key: pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": tokens, "over_limit": tokens > limit})

    of_documents = blocks.select("block", "ids", "n_bytes", "sizes", "codes", "counts").groupBy("block")
    return of_documents.cogroup(counted_pieces.groupBy("block")).applyInArrow(summed, result)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

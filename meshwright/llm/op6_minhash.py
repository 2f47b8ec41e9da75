"""Near-duplicate documents by BagMinHash over the multiset of 5-word shingles.

A shingle with count ``w`` covers the weights ``[0, w)``. Those are discretised into the intervals [0, 1), [1, 2),
[2, 4), [4, 8), ...; each shingle has a Poisson process for each interval that begins below ``w``, with a rate of the
interval's length, whose points carry a weight inside the interval and a register. A point counts if its weight is below
``w``, so documents share exactly the points below the smaller of their counts, and a register's first point is the
same in two documents with a probability of their weighted Jaccard similarity. Points come in order of time and a
process stops when it is past the latest register of its document, as published. ``BANDS`` bands of ``ROWS``
registers give the buckets; pairs are verified by the exact multiset overlap (sum of minima over sum of maxima).

Texts that are equal are one class from the start, and only one document of each goes on. Within a bucket, each member is
compared with the one that has most neighbours, and then only pairs that may still join two groups are compared; weighted
Jaccard distance is a metric, so most of those are ruled out by distances that are known (:func:`groups.near_groups`). Large
groups of copies leave many that the metric doesn't rule out; there, each text's multiset of shingles that texts of other
groups have as well bounds its overlap with any of them (:func:`common_mass`), so texts with too many shingles of their
own are out without a comparison. The bound is exact: no link is lost.

Defined results: null and empty texts are equal texts and form one class; texts of fewer than five words have no
shingles and are near to equal texts only; letter case of A-Z doesn't matter for shingles; very long texts are hashed
whole; a class is named by its least doc_id; rows without an id are searched like others, and a class of such rows only
has no name (null); rows that share an id are judged each by its own text, whatever their order; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import Words, as_bytes, mix, parts, per_text, released, stored, table
from meshwright.llm.groups import near_groups

SHINGLE, BANDS, ROWS, SIMILARITY, STEP = 5, 21, 6, 0.8, 1 << 20
REGISTERS = BANDS * ROWS
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def shingle_counts(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every distinct shingle of every text, by text."""
    hashes, at = words.windows(n)
    if not len(at):
        return np.zeros(0, np.int64), hashes, np.zeros(0, np.int64)
    text = words.text[at]
    order = np.argsort(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))
    t, h = text[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]))
    return t[new], h[new], np.diff(np.concatenate([new, [len(t)]]))


def registers(n_texts: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, size: int = REGISTERS) -> np.ndarray:
    """The time of the first point in each register of each text; infinite for a text without shingles."""
    first = np.full(n_texts * size, np.inf)
    owner, seed, low, width, weight, k = [], [], [], [], [], 0
    lower = 0
    while True:
        has = count > lower
        if not has.any():
            break
        owner.append(text[has])
        seed.append(mix(shingle[has] + np.uint64(k * int(_B) % (1 << 64))))
        weight.append(count[has])
        low.append(np.full(has.sum(), lower))
        width.append(np.full(has.sum(), max(1, lower)))
        k, lower = k + 1, max(1, 2 * lower)
    if not owner:
        return first.reshape(n_texts, size)
    owner, seed, low, width, weight = map(np.concatenate, (owner, seed, low, width, weight))
    time, drawn, many = np.zeros(len(owner)), 0, 1
    while len(owner):
        steps = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * _A
        one = mix(seed[:, None] + steps)
        two = mix(one ^ _B)
        gaps = -np.log(((one >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None]
        times = time[:, None] + np.cumsum(gaps, 1)
        at = owner[:, None] * size + ((two >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        inside = low[:, None] + width[:, None] * ((two & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32) < weight[:, None]
        np.minimum.at(first, at[inside], times[inside])
        latest = first.reshape(n_texts, size).max(1)
        more = times[:, -1] < latest[owner]
        owner, seed, low, width, weight, time = owner[more], seed[more], low[more], width[more], weight[more], times[more, -1]
        drawn += many
        many = int(min(64, max(1, 200_000 // max(1, len(owner)))))
    return first.reshape(n_texts, size)


def bands(first: np.ndarray) -> np.ndarray:
    """A hash of each band of registers."""
    bits = first.view(np.uint64).reshape(len(first), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _B, (len(first), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * _A + bits[:, :, r])
    return out.view(np.int64)


def signatures(df: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and band hashes (none for a text without shingles) of every document."""

    def step(keys: list, texts: list[bytes]) -> dict:
        first = registers(len(texts), *shingle_counts(Words([t.lower() for t in texts])))
        found = np.isfinite(first[:, 0])
        return {"doc_id": keys, "digest": [hashlib.md5(t).digest() for t in texts], "bands": [b if f else [] for b, f in zip(bands(first), found, strict=True)]}

    return per_text(df, "doc_id", "text", "doc_id long, digest binary, bands array<long>", step, STEP)


def overlap(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    text, shingle, count = shingle_counts(Words([t.lower() for t in left + right]))
    pair, side = text % n, text >= n
    order = np.lexsort((side, shingle, pair))
    p, h, c = pair[order], shingle[order], count[order]
    both = np.flatnonzero((p[1:] == p[:-1]) & (h[1:] == h[:-1]))
    common = np.bincount(p[both], np.minimum(c[both], c[both + 1]), n)
    total = np.bincount(pair, count, n)
    return common / np.maximum(1, total - common)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, distance, near) of the pairs (a, b): one minus the similarity of their texts, which is a metric. texts: doc_id, text."""
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    packed = pairs.join(of("a"), "a").join(of("b"), "b").select(F.struct("a", "b").alias("pair"), F.struct("text_a", "text_b").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, STEP, batch.column(1).field(0), batch.column(1).field(1)):
                pair, both = part.column(0), part.column(1).flatten()
                value = overlap(*map(as_bytes, both))
                yield pa.RecordBatch.from_arrays([*pair.flatten(), pa.array(1 - value), pa.array(value >= similarity)], names=["a", "b", "distance", "near"])

    return packed.mapInArrow(run, "a long, b long, distance double, near boolean")


def text_id(text: str) -> Column:
    """A 64-bit id of each distinct text; a null text is the empty one."""
    return F.xxhash64(F.unhex(F.md5(F.coalesce(text, F.lit("")))))


def common_mass(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(id, bound) of rows (id, root): a struct of a text's number of shingles and of how many of those texts of another root have too, at most.

    No text of another root overlaps by more than the latter; the bound is null where that alone rules out the similarity. texts: doc_id, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, STEP, 2):
                ids, roots = part.column(0).to_numpy(), part.column(1).to_numpy()
                text, shingle, count = shingle_counts(Words([t.lower() for t in as_bytes(part.column(2))]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(roots[text]), pa.array(shingle.view(np.int64)), pa.array(count)], names=["id", "root", "shingle", "n"])

    held = rows.join(texts.select(F.col("doc_id").alias("id"), "text").hint("merge"), "id").select("id", "root", "text")
    counts = stored(held.mapInArrow(run, "id long, root long, shingle long, n long"))
    spread = counts.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    shared = counts.join(spread.hint("merge"), "shingle").groupBy("id").agg(F.sum("n").alias("shared"))
    sizes = counts.groupBy("id").agg(F.sum("n").alias("size")).join(shared.hint("merge"), "id", "left")
    bound = F.struct("size", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))
    out = stored(sizes.select("id", F.when(F.col("shared") >= similarity * F.col("size") - 1e-6, bound).alias("bound")))
    released(counts)
    return out


def may_overlap(similarity: float):  # noqa: ANN201
    """The test of two bounds (size, shared): whether their texts can reach the similarity."""

    def test(a: Column, b: Column) -> Column:
        most = F.least(a["shared"], b["shared"])
        return most >= similarity * (a["size"] + b["size"] - most) - 1e-6

    return test


def _classes(documents: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id) of every row, and :func:`near_classes`."""
    signed = stored(signatures(documents).select("doc_id", F.xxhash64("digest").alias("id"), "bands"))
    texts_of = signed.groupBy("id").agg(F.min("doc_id").alias("least"))
    members = stored(signed.select("id", F.explode("bands").alias("key")).distinct())
    wanted = members.join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").hint("merge"), "key", "left_semi")
    wanted = wanted.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    # only texts of documents that share a bucket are moved, and once
    texts = stored(documents.select(text_id("text").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    bounds = (lambda rows: common_mass(rows, texts, similarity), may_overlap(similarity))
    roots = near_groups(members, lambda pairs: verified(pairs, texts, similarity), 1 - similarity + 1e-9, bounds=bounds)
    released(members, texts)
    grouped = stored(texts_of.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    released(roots)
    least = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    return signed.select("doc_id", "id"), grouped.join(least, "root").select("id", "root", "class_id")


def near_classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id (:func:`text_id`), root and class_id of every distinct text: root is the id of one text of its group of near copies, class_id the group's least doc_id (null if no row of the group has one)."""
    return _classes(documents, similarity)[1]


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row of ``documents`` (doc_id, text): the least doc_id of its group of near copies."""
    rows, classes = _classes(documents, similarity)
    return rows.join(classes, "id").select("doc_id", "class_id")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))

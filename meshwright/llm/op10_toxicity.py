"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Both dictionaries hold the same ordinary passages around a slot of equal size. The slot of the toxic one holds every
segment (word, or beginning of one) that more toxic training texts have than chance allows: at least ``RATIO`` times the
share of ordinary ones, and a probability, by the Chernoff bound of the binomial tail, of at most ``LEVEL`` over all
segments together. The slot of the ordinary one holds further ordinary text. Texts are counted, not occurrences, and
near copies once, since they aren't independent. A window is one word with the spaces around it between two copies of a
passage that both dictionaries have, since zstandard looks for no match in the last bytes of its input and stores short
inputs that don't shrink as they are. The difference of a window's two compressed lengths tells how much of it is known
from toxic text. Equal windows have equal lengths, so each worker keeps those it has seen, up to a bound.

A document's differences give a log-likelihood ratio (learnt for each size of difference) and counts of large ones; a
logistic model calibrates these into a probability. Everything is learnt from a bounded sample of labelled rows
(``SAMPLE`` of each class, by hash of the id); scores use whole texts.

Defined results: a null, empty or blank text has no windows and gets the score of no evidence; equal texts get equal
scores; without training rows of both classes every score is the share of toxic ones (0.5 when there are none); a
document labelled more than once is learnt from once for each label row, conflicting ones included; an empty table gives an empty table; further columns are ignored, and labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import Words, held_out, mix, per_text, released, stored, table

SAMPLE, DICTIONARY, FILLER, BINS, CUT = 2000, 8192, 48, 7, 0.7
RATIO, LEVEL, ROUNDS, SHINGLE, PASSAGES, PASSAGE_WORDS = 6.0, 0.05, 4, 5, 400, 8
CACHED_BYTES, CACHED_WORDS = 64, 400_000


def segments(text: bytes) -> set[bytes]:
    """The words of a text and their beginnings of 4 to 9 bytes that end with a character."""
    out = set()
    for word in set(text.lower().split()):
        out.update(b" " + word[:k] for k in range(4, min(len(word), 10)) if word[k] & 0xC0 != 0x80)
        out.add(b" " + word + b" ")
    return out


def segment_counts(sample: DataFrame) -> DataFrame:
    """(segment, toxic, ordinary): in how many of the sample's texts of each class it is. sample: toxic, text."""

    def step(keys: list, texts: list[bytes]) -> dict:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for k, t in zip(keys, texts, strict=True):
            total[k].update(segments(t))
        names = list(total[0] | total[1])
        return {"segment": names, "toxic": [total[1][s] for s in names], "ordinary": [total[0][s] for s in names]}

    return per_text(sample, "toxic", "text", "segment binary, toxic long, ordinary long", step, 8 << 20).groupBy("segment").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def apart(sample: DataFrame) -> DataFrame:
    """toxic and text of the least one of the texts of a class that ``ROUNDS`` MinHashes of runs of ``SHINGLE`` words bring together, one after the other; shorter texts are their own."""

    def step(keys: list, texts: list[bytes]) -> dict:
        hashes, at = (words := Words(texts)).windows(SHINGLE)
        own = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts], np.uint64)
        least = np.full((ROUNDS, len(texts)), np.iinfo(np.uint64).max, np.uint64)
        for k in range(ROUNDS):
            np.minimum.at(least[k], words.text[at], mix(hashes ^ np.uint64(k)))
        least[:, words.count < SHINGLE] = own[words.count < SHINGLE]
        return {"toxic": keys, "text": [t.decode() for t in texts], "least": least.view(np.int64).T.tolist()}

    found = per_text(sample, "toxic", "text", "toxic int, text string, least array<long>", step)
    for k in range(ROUNDS):
        found = found.groupBy("toxic", F.col("least")[k]).agg(F.min(F.struct("text", "least")).alias("kept")).select("toxic", "kept.text", "kept.least")
    return found.select("toxic", "text")


def choose_segments(counts: DataFrame, toxic: int, ordinary: int, ratio: float = RATIO, level: float = LEVEL) -> list[bytes]:
    """The segments that toxic texts have more often than chance allows, none inside another, each as long as most of its texts allow; what speaks most first. counts: stored."""
    t, o = F.col("toxic"), F.col("ordinary")
    n, share = t + o, F.lit(toxic / (toxic + ordinary))
    odds = ((t + 0.5) / toxic) / ((o + 0.5) / ordinary)
    chance = t * F.log(t / n / share) + F.when(o > 0, o * F.log(o / n / (1 - share))).otherwise(0.0)
    least = math.log(max(1, counts.count()) / level)
    rows = counts.where((t > 0) & (odds >= ratio)).where(chance >= least).select("segment", "toxic", chance.alias("score"))
    found = sorted(((bytes(r["segment"]), r["toxic"], r["score"]) for r in rows.collect()), key=lambda f: (-f[2], -len(f[0]), f[0]))
    out: list[bytes] = []
    for s, held, _ in found:
        if not any(other.strip() in s or s.strip() in other for other in out):
            out.append(max((f for f in found if s in f[0] and f[1] >= 0.6 * held), key=lambda f: (len(f[0]), f[2], f[0]))[0])
    return out


class Distance(dict):
    """The difference of compressed lengths of each word's window."""

    def __init__(self, ordinary: bytes, toxic: bytes, filler: bytes):
        super().__init__()
        self.filler = filler
        settings = zstd.ZstdCompressionParameters.from_level(6, write_content_size=False, write_dict_id=False, min_match=4, strategy=zstd.STRATEGY_LAZY2)
        self.by_ordinary, self.by_toxic = (zstd.ZstdCompressor(compression_params=settings, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)) for d in (ordinary, toxic))

    def __missing__(self, word: bytes) -> int:
        window = self.filler + b" " + word + b" " + self.filler
        d = min(BINS - 1, max(0, len(self.by_ordinary.compress(window)) - len(self.by_toxic.compress(window))))
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = d
        return d


def dictionaries(passages: list[bytes], chosen: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """The ordinary and the toxic dictionary, and the filler that both end with."""
    slot, text = b"".join(reversed(chosen)), b" ".join(passages)
    least = DICTIONARY + len(slot)
    if len(text) < least:
        text = (text + b" ") * (least // (len(text) + 1) + 1)
    shared, rest = text[:DICTIONARY], text[DICTIONARY : DICTIONARY + len(slot)]
    half = DICTIONARY // 2
    return shared[:half] + rest + shared[half:], shared[:half] + slot + shared[half:], shared[-FILLER:]


_loaded: dict[tuple, Distance] = {}


def histogram(model: tuple[bytes, bytes, bytes], text: bytes) -> list[int]:
    """How many words of a text have each difference of lengths."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Distance(*model)
    found = Counter(map(_loaded[model].__getitem__, text.lower().split()))
    return [found[k] for k in range(BINS)]


def histograms(df: DataFrame, key: str, model: tuple[bytes, bytes, bytes]) -> DataFrame:
    """key, counts: :func:`histogram` of every whole text."""

    def step(keys: list, texts: list[bytes]) -> dict:
        return {key: keys, "counts": [histogram(model, t) for t in texts]}

    return per_text(df, key, "text", f"`{key}` {dict(df.dtypes)[key]}, counts array<long>", step, 8 << 20)


class Calibration:
    """From histograms to probabilities."""

    def __init__(self, counts: np.ndarray, toxic: np.ndarray):
        by = [np.array([counts[toxic == c].sum(0)[k] for k in range(BINS)]) + 0.5 for c in (0, 1)]
        self.ratio = np.log(by[1] / by[1].sum()) - np.log(by[0] / by[0].sum())
        f = self.features(counts)
        self.mean, self.deviation = f.mean(0), f.std(0) + 1e-9
        x, self.weights = self.scaled(f), np.zeros(f.shape[1] + 1)
        for _ in range(60):  # Newton's steps of a ridge-penalised logistic model
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (p - toxic) / len(x) + 1e-3 * self.weights
            self.weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-3 * np.eye(x.shape[1]), slope)

    def features(self, counts: np.ndarray) -> np.ndarray:
        counts = np.asarray(counts, float)
        hits = [counts[:, k:].sum(1) for k in (2, 3, 4)]
        total = counts.sum(1)
        return np.stack([np.clip(counts @ self.ratio, -8, 12), *(np.log1p(h) for h in hits), *(np.log((h + 0.2) / (total + 30)) for h in hits)], 1)

    def scaled(self, f: np.ndarray) -> np.ndarray:
        return np.concatenate([(f - self.mean) / self.deviation, np.ones((len(f), 1))], 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        z = np.clip(self.scaled(self.features(counts)) @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


def sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of at most ``SAMPLE`` labelled documents of each class that may be learnt from."""
    free = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", 3, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    first = lambda c: free.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return documents.select("doc_id", "text").join(F.broadcast(first(0).unionByName(first(1))), "doc_id").select("toxic", "text")


def passages(sample: DataFrame, n: int = PASSAGES, words: int = PASSAGE_WORDS) -> list[bytes]:
    """``n`` passages of the ordinary texts of the sample, drawn by hash from all passages of the whole texts."""

    def step(keys: list, texts: list[bytes]) -> dict:
        lists = [t.lower().split() for t in texts]
        found = [b" ".join(w[k : k + words]) for w in lists for k in range(0, len(w), words)]
        return {"toxic": [0] * len(found), "passage": found}

    found = per_text(sample.where("toxic = 0"), "toxic", "text", "toxic int, passage binary", step)
    return [bytes(r["passage"]) for r in found.orderBy(F.xxhash64("passage"), "passage").limit(n).collect()]


def fit(documents: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes, bytes], Calibration] | float:
    """The dictionaries and the calibration, or the constant score where a class has no training row."""
    sample = stored(sampled(documents, labels))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        released(sample)
        return float(next(iter(size), 0.5))
    texts = stored(apart(sample))
    distinct = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    counts = stored(segment_counts(texts))
    model = dictionaries(passages(texts), choose_segments(counts, distinct[1], distinct[0]))
    rows = histograms(sample, "toxic", model).collect()  # 2 * SAMPLE rows of BINS numbers at most
    released(sample, texts, counts)
    return model, Calibration(np.array([r["counts"] for r in rows]), np.array([r["toxic"] for r in rows]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    fitted = fit(documents, labels)

    def step(keys: list, texts: list[bytes]) -> dict:
        if isinstance(fitted, float):
            scores = np.full(len(keys), fitted)
        else:
            scores = fitted[1](np.array([histogram(fitted[0], t) for t in texts]))
        return {"doc_id": keys, "score": scores}

    scored = per_text(documents, "doc_id", "text", "doc_id long, score double", step)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every passage of ``PASSAGE`` words is encoded by features of its bytes and words and a learnt layer; gated attention
(tanh times sigmoid, as published for multiple-instance learning) weighs the passages of a document; the weighted
sum of its passages is scored by a logistic output. All weights are learnt together from document labels, by
gradient steps (Adam) in numpy, from a bounded sample of labelled rows (``SAMPLE``, by hash of the id; a training
document gives at most ``BAG`` passages, evenly spaced). Scores use all passages of the whole text.

Defined results: a null, empty or blank text has one passage whose features are all zero; equal texts get equal scores,
rounded to six places; without training rows of both classes every score is the share of good ones (0.5 when
there are none); a document labelled more than once is learnt from once for each label row, conflicting ones included; an
empty table gives an empty table; further columns are ignored, and labels, lang, source and doc_id
are no inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import Words, held_out, mix, per_text, table

PASSAGE, SAMPLE, BAG, HIDDEN, GATES, STEPS, CUT = 64, 6000, 256, 16, 8, 400, 0.3

_CLASSES = {
    "symbol": b"#*$%&<>", "bar": b"|", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "stop": b".,;:", "shout": b"!?", "line": b"\n", "wide": bytes(range(0xC0, 0x100)), "other": b"\"'()[]{}/\\@_=+-~`^",
}
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _k + 1
N_FEATURES = len(_CLASSES) + 8


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and for each text the index of its first passage (and one more at the end)."""
    words = Words(texts)
    n = np.maximum(1, -(-words.count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((first[-1], N_FEATURES))
    if not len(words.starts):
        return out, first
    inside = np.arange(len(words.starts)) - words.first[words.text]
    at = first[words.text] + inside // PASSAGE
    per = np.maximum(1, np.bincount(at, minlength=len(out)))[:, None]
    # a byte belongs to the passage of the last word that began before it
    begun = np.zeros(len(words.bytes), np.int64)
    begun[words.starts] = 1
    owner = np.cumsum(begun) - 1
    started = owner >= 0
    kinds = np.bincount(at[owner[started]] * 11 + _CLASS[words.bytes[started]], minlength=len(out) * 11).reshape(-1, 11)
    size = words.ends - words.starts
    sums = lambda x: np.bincount(at, x, minlength=len(out))[:, None] / per
    same = lambda k: np.concatenate([np.zeros(k, bool), (words.hash[k:] == words.hash[:-k]) & (words.text[k:] == words.text[:-k])])[: len(size)]
    ends = words.bytes[words.ends - 1]
    keys = np.unique(words.hash ^ mix(at.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(at[keys], minlength=len(out))[:, None] / per
    mean = sums(size)
    out[:] = np.concatenate(
        [
            kinds[:, 1:] / np.maximum(1, kinds.sum(1))[:, None], mean / 10, np.sqrt(np.maximum(0, sums(size.astype(float) ** 2) - mean**2)) / 10,
            sums(same(1)), sums(same(2)), distinct, sums(size <= 3), sums((ends == 46) | (ends == 44)), np.log1p(per) / 5,
        ], 1,
    )
    return out, first


class Network:
    """The encoder, the gates and the unit that scores; weights are drawn from a fixed seed."""

    def __init__(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS):
        self.mean, self.deviation = x.mean(0), x.std(0) + 1e-6
        r = np.random.default_rng(11)
        draw = lambda *shape: r.normal(0, shape[0] ** -0.5, shape)
        self.w = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "a": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(1)}
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        x = self._scaled(x)
        for t in range(1, steps + 1):
            for k, g in self._slopes(x, first, y).items():
                g = g + 1e-4 * self.w[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.w[k] = self.w[k] - 0.02 * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8)

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        w, bag = self.w, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ w["W"] + w["b"])
        u, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (u * g) @ w["a"]
        e = np.exp(raw - np.maximum.reduceat(raw, first[:-1])[bag])
        alpha = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(alpha[:, None] * h, first[:-1])
        return {"bag": bag, "h": h, "u": u, "g": g, "alpha": alpha, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}

    def _slopes(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        w, f = self.w, self._forward(x, first)
        h, u, g, alpha, bag = f["h"], f["u"], f["g"], f["alpha"], f["bag"]
        logit = (f["p"] - y) / len(y)
        dz = logit[bag, None] * w["c"]
        dalpha = (dz * h).sum(1)
        raw = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first[:-1])[bag])
        gated = raw[:, None] * w["a"]
        du, dg = gated * g * (1 - u * u), gated * u * g * (1 - g)
        pre = (alpha[:, None] * dz + du @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ pre, "b": pre.sum(0), "V": h.T @ du, "U": h.T @ dg, "a": (u * g).T @ raw, "c": f["z"].T @ logit, "d": logit.sum(keepdims=True)}

    def __call__(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x), first)["p"]


def sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, text of at most ``SAMPLE`` labelled documents that may be learnt from."""
    free = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = free.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")


def fit(documents: DataFrame, labels: DataFrame) -> Network | float:
    """The trained network, or the constant score where a class has no training row."""

    def step(keys: list, texts: list[bytes]) -> dict:
        x, first = passage_features(texts)
        some = [x[np.unique(np.linspace(a, b - 1, min(BAG, b - a)).astype(int))] for a, b in zip(first[:-1], first[1:], strict=True)]
        return {"quality": keys, "passages": [s.astype("<f8").tobytes() for s in some]}

    rows = per_text(sampled(documents, labels), "quality", "text", "quality int, passages binary", step).collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["passages"])))  # so that the order of arrival doesn't matter
    y = np.array([r["quality"] for r in rows], float)
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    bags = [np.frombuffer(r["passages"], "<f8").reshape(-1, N_FEATURES) for r in rows]
    return Network(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def judged(documents: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``key``, score and predicted of every document."""
    net = fit(documents, labels)

    def step(keys: list, texts: list[bytes]) -> dict:
        return {key: keys, "score": np.full(len(keys), net) if isinstance(net, float) else np.round(net(*passage_features(texts)), 6)}

    scored = per_text(documents, key, "text", f"`{key}` {dict(documents.dtypes)[key]}, score double", step)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = judged(documents.withColumn("doc_id", F.col("doc_id").cast("long")), labels, "doc_id")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

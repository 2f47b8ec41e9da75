"""Quality rules with risk-controlled thresholds.

Every text gets counts of words, word characters, symbols, repeated lines and repeated 8-word windows. From the labelled
documents, each rule gets a cutoff for each stratum (class of length): the cutoffs of a fixed grid are tested from the
loosest to the strictest (a fixed sequence, which needs no correction of its own), each by the exact binomial
(Clopper-Pearson) upper bound of the share of good documents that it would reject; testing stops at the first bound over
the limit. The level is divided by the number of rules times strata (Bonferroni), and the limit by the number of rules,
so with probability ``1 - level`` all rules together reject at most ``limit`` of the good documents of every stratum.
Among the certified cutoffs the one that parts bad from good best is used. A rule without a certified cutoff in a
stratum is off there: too few labels never reject anything.

Counts are gathered from all labelled rows; only the counts of (stratum, rule, grid step, label) reach the driver.

Defined results: a null or empty text has no words, and so fails the base rule; a long text is counted whole; repeated
rows are judged alike, each in its own row; labels without a document or without a value don't count; equal texts with
equal labels count once, since the exact bound needs independent documents (near copies of a labelled document count
each, so the bound is looser than stated where labels hold many); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import Words, mix, per_text, stored, table

LIMIT, LEVEL, STEPS = 0.04, 0.05, 40
#: Upper ends of the classes of length, in words; the last class has none.
STRATA = (100, 500)

_CHAR = np.ones(256, np.int64)
_CHAR[0x80:0xC0] = 0
_CHAR[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Words, n: int = 8) -> np.ndarray:
    """For each text, its words in windows of ``n`` words that it has twice or more."""
    covered = np.zeros(len(words.starts) + 1, np.int64)
    hashes, at = words.windows(n)
    if len(at):
        hashes = hashes ^ mix(words.text[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return np.diff(inside[words.first])


def _step(keys: list, texts: list[bytes]) -> dict:
    words, lines = Words(texts), [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "doc_id": keys,
        "digest": [hashlib.blake2b(t, digest_size=16).digest() for t in texts],
        "n_words": words.count,
        "word_chars": np.add.reduceat(_CHAR[words.bytes], words.offsets[:-1]),
        "n_symbols": np.add.reduceat(_SYMBOL[words.bytes], words.offsets[:-1]),
        "n_lines": list(map(len, lines)),
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": repeated_words(words),
    }


def text_stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of every whole text, and a 128-bit digest of it."""
    return per_text(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "doc_id long, digest binary, " + ", ".join(f"{n} long" for n in STATS), _step)


def rules() -> dict[str, tuple[Column, float]]:
    """Each rule's value, larger for worse texts, and the largest step of its grid."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": (F.col("n_symbols") / chars, 0.4),
        "repeats": (F.col("n_repeat_words") / words, 1.0),
        "lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 1.0),
        "long_words": (F.col("word_chars") / words, 40.0),
    }


def stratum() -> Column:
    """The class of length."""
    return sum((F.when(F.col("n_words") >= end, 1).otherwise(0) for end in STRATA), F.lit(0))


def beta_share(p: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's evaluation)."""
    if p <= 0 or p >= 1:
        return float(p >= 1)
    if p > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - p, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p)) / a
    tiny, d = 1e-300, 1 / (1 - (a + b) * p / (a + 1))
    c, value = 1.0, d
    for m in range(1, 100_000):
        for term in (m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + term * d) or tiny), (1 + term / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def upper_bound(rejected: int, total: int, level: float) -> float:
    """The Clopper-Pearson upper bound of a share: the p at which P(X <= rejected) falls to ``level``."""
    if rejected >= total:
        return 1.0
    low, high = rejected / total, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if 1 - beta_share(p, rejected + 1, total - rejected) > level else (low, p)
    return high


def choose(good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> int | None:
    """The grid step whose cutoff is used. good, bad: labelled documents by the step that their value reaches."""
    above = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])  # noqa: E731  a cutoff of step k rejects values of step k or more
    worse, better, best, chosen = above(bad), above(good), 0.0, None
    if not good.sum():
        return None
    for k in range(len(good), 0, -1):
        if better[k] > limit * good.sum() or upper_bound(int(better[k]), int(good.sum()), level) > limit:
            break
        gain = worse[k] / max(1, bad.sum()) - 20 * better[k] / good.sum()
        if gain > best + 1e-12:
            best, chosen = gain, k
    return chosen


def cutoffs(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> dict[tuple[int, str], float]:
    """The cutoff of each stratum and rule that has a certified one. labels: doc_id, quality."""
    rule, grid = rules(), {name: top / STEPS for name, (_, top) in rules().items()}
    marked = labels.where("quality IN (0, 1)").select("doc_id", "quality").join(stats, "doc_id").select("quality", "digest", *STATS).distinct()
    steps = F.array(*(F.struct(F.lit(n).alias("rule"), F.least(F.floor(v / grid[n]), F.lit(STEPS)).cast("int").alias("step")) for n, (v, _) in rule.items()))
    counted = marked.select("quality", stratum().alias("stratum"), F.explode(steps).alias("at")).groupBy("quality", "stratum", "at.rule", "at.step").count()
    found: dict[tuple[int, str], np.ndarray] = {}
    for r in counted.collect():  # at most 2 * strata * rules * (STEPS + 1) rows
        found.setdefault((r["stratum"], r["rule"]), np.zeros((2, STEPS + 1), np.int64))[r["quality"], r["step"]] += r["count"]
    tests = len(rule) * (len(STRATA) + 1)
    chosen = {k: choose(c[1], c[0], limit / len(rule), level / tests) for k, c in sorted(found.items())}
    return {k: step * grid[k[1]] for k, step in chosen.items() if step is not None}


def verdict(chosen: dict[tuple[int, str], float]) -> Column:
    """True unless a rule's value reaches its cutoff in the row's stratum."""
    values, ok = rules(), F.lit(True)
    for (s, name), cut in chosen.items():
        grid = values[name][1] / STEPS
        ok = ok & ~((stratum() == s) & (F.floor(values[name][0] / grid) >= round(cut / grid)))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_rules(documents: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """The counts of every document, whether it fails the base rule, and whether it is kept."""
    stats = stored(text_stats(documents))
    chosen = cutoffs(stats, labels, limit, level)
    return stats.drop("digest").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(chosen))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *(n for n in STATS if n != "n_lines"), "base_failed", "kept")

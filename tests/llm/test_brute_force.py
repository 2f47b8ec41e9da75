"""Verdicts, exponents, balance and chosen segments against plain versions on whole tables."""

import collections
import math

import numpy as np
import pytest

from meshwright.llm import op7_packing, op8_mixing, op9_rules, op10_toxicity


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def binomial_tail(k, n, p):
    """P(X <= k) of n draws, term by term."""
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_verdicts_of_rules(real):
    docs, labels = real
    rows = op9_rules.quality_rules(docs, labels).toPandas().set_index("doc_id")
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    words, chars = rows.n_words.clip(lower=1), rows.word_chars.clip(lower=1)
    values = {"symbols": (rows.n_symbols / chars, 0.4), "repeats": (rows.n_repeat_words / words, 1.0), "lines": (rows.n_dup_lines / rows.n_lines.clip(lower=1), 1.0), "long_words": (rows.word_chars / words, 40.0)}
    stratum = (rows.n_words >= 100).astype(int) + (rows.n_words >= 500)
    marked = {}
    for doc, quality in labels.where("quality IN (0, 1)").select("doc_id", "quality").collect():
        if doc in rows.index:
            marked[(texts[doc] or "", quality)] = doc
    rejected = (rows.n_words < 20) | (100 * rows.n_repeat_words > 30 * rows.n_words)
    limit, level = 0.04 / 4, 0.05 / 12
    for value, top in values.values():
        step = np.minimum(np.floor(value / (top / 40)), 40).astype(int)
        for s in range(3):
            good, bad = ([step[d] for (_, q), d in marked.items() if q == wanted and stratum[d] == s] for wanted in (1, 0))
            best, chosen = 0.0, None
            for k in range(41, 0, -1):
                over = sum(x >= k for x in good)
                if not good or over > limit * len(good) or binomial_tail(over, len(good), limit) > level:
                    break
                gain = sum(x >= k for x in bad) / max(1, len(bad)) - 20 * over / len(good)
                if gain > best + 1e-12:
                    best, chosen = gain, k
            if chosen is not None:
                rejected |= (stratum == s) & (step >= chosen)
    assert (rows.kept == ~rejected).all() and 0 < rejected.sum() < len(rows)


@pytest.mark.parametrize("entropy, limit", [(0.99, 4.0), (0.9, None), (None, 1.5), (0.97, 1.2)])
def test_exponent_of_mixing(real, entropy, limit):
    rows = op8_mixing.planned(real[0], entropy=entropy, limit=limit).groupBy("source").agg({"n_tokens": "sum", "weight": "max"}).toPandas()
    share = (rows["sum(n_tokens)"] / rows["sum(n_tokens)"].sum()).to_numpy()
    share, weight = share[share > 0], rows["max(weight)"].to_numpy()[share > 0]
    x = np.linspace(0, 1, 20_001)
    powers = share[None, :] ** x[:, None]
    weights = powers / powers.sum(1, keepdims=True)
    flat = -(weights * np.log(weights)).sum(1) >= (entropy or 0) * math.log(len(share)) - 1e-12
    rare = (weights / share).max(1) <= (limit or math.inf)
    at = max(x[flat].max() if entropy else 0.0, x[rare].min() if limit else 0.0)
    expected = share**at / (share**at).sum()
    assert np.abs(weight - expected).max() < 1e-4


def test_packed_costs_are_balanced(real):
    docs = real[0].repartition(1).sortWithinPartitions("doc_id")
    pieces = op7_packing.pack(docs).toPandas()
    cost = lambda n: n + n * n / 1024
    rest = pieces[pieces.length < 2048]
    full = rest.groupby("sequence_id").length.sum()
    rest = rest[rest.sequence_id.isin(full[full == 2048].index)]
    packed = cost(rest.length).groupby(rest.sequence_id).sum()
    left = pieces.groupby("doc_id").doc_tokens.first() % 2048
    sizes = sorted(left[left > 0], reverse=True)
    rooms, costs = np.full(sum(sizes) // 2048, 2048), np.zeros(sum(sizes) // 2048)
    for n in sizes:  # the same descending order, but into the first sequence with room
        while n and rooms.any():
            k = int(np.argmax(rooms >= n) if (rooms >= n).any() else np.argmax(rooms > 0))
            taken = min(n, rooms[k])
            rooms[k], costs[k], n = rooms[k] - taken, costs[k] + cost(taken), n - taken
    spread = np.std(packed) / np.mean(packed), np.std(costs) / np.mean(costs)
    print("spread of costs:", spread)
    assert len(packed) > 100 and spread[0] < spread[1] and packed.max() <= costs.max()


def test_segments_are_those_that_chance_excludes(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k:04d}x" for k in range(3000)]
    rows = [(int(k % 4 == 0), " ".join([*rng.choice(vocabulary, 60), *(["badword"] if k % 8 == 0 else []), *(["rarely"] if k % 97 == 0 else [])])) for k in range(800)]
    copy = " ".join(rng.choice(vocabulary, 200)).split()
    for k in range(60):  # near copies of one toxic text
        rows.append((1, " ".join([*copy[:100], f"changed{k}", *copy[101:], *(["copied"])])))
    sample = spark.createDataFrame([*rows, *rows[:50]], "toxic int, text string")
    texts = op10_toxicity.apart(sample).persist()
    assert texts.where("toxic = 1 AND text LIKE '%copied'").count() <= 3 and texts.where("text NOT LIKE '%copied'").count() == 800
    held = collections.Counter((t, s) for t, x in texts.collect() for s in {b" " + w.encode() + b" " for w in x.split()})
    counts = op10_toxicity.segment_counts(texts).persist()
    assert all(held[1, bytes(s)] == t and held[0, bytes(s)] == o for s, t, o in counts.collect() if bytes(s).endswith(b" "))
    assert op10_toxicity.choose_segments(counts, 203, 600) == [b" badword "]


def test_segments_end_with_characters():
    assert all(s.decode() for s in op10_toxicity.segments("ééééé 日本語日本語 abcdefghijkl".encode()))
    assert op10_toxicity.segments(b"") == set() and max(map(len, op10_toxicity.segments(b"y" * 50_000))) == 50_002


def test_toxic_documents_and_false_alarms(spark, real):
    for size, found, alarms in (("sf0.01", 0.6, 0.02), ("sf0.1", 0.7, 0.01)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
        rows = op10_toxicity.toxicity(docs, labels).join(labels.where("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
        assert rows[rows.toxic == 1].predicted.mean() >= found and rows[rows.toxic == 0].predicted.mean() <= alarms

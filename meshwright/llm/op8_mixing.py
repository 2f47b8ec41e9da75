"""Temperature mixing of sources to target weights, with DataFrame and SQL functions only.

A source with the share ``p`` of all tokens (words) gets a weight in proportion to ``p ** exponent``. The exponent lies
between 0 (equal weights) and 1 (natural shares). It is bisected, five halvings a job, to the largest value that reaches
the target entropy (a share of the logarithm of the number of sources), and from below to the smallest value at which no
source is repeated more often than the limit; the limit wins. Only sums and maxima over sources reach the driver.

A source's weight is realised as a budget of tokens: whole copies of the source, and for the rest a prefix of a
permutation of its documents. The permutation goes block by block: documents are dealt to blocks of about
``BLOCK_ROWS`` by a hash of their id, sums of blocks say which blocks the prefix holds whole, and only the one block that
it ends in is ordered by hash. So no task holds a source, however much of the corpus that is.

Defined results: a null text has no tokens; a null source is a source of its own; documents without tokens are part of
every copy and of blocks that are held whole, and a source without any tokens gets one copy; documents with equal ids or
hashes are ordered by id and taken together where their order can't be told; a budget is never exceeded by more than
such ties; an empty table gives an empty table; further columns are kept by :func:`mixed` and ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm.common import fresh, stored, table

ENTROPY, LIMIT, BLOCK_ROWS, SEED, HALVINGS = 0.99, 4.0, 4096, 17, 25


def n_tokens(text: str = "text") -> Column:
    """The words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisected(sources: DataFrame, tests: dict[str, tuple], halvings: int = HALVINGS) -> dict[str, float]:
    """For each test, the border in [0, 1] between exponents that pass and that fail. A test is (columns of an exponent, verdict of their values, whether low exponents pass)."""
    span = {name: (0.0, 1.0) for name in tests}
    for _ in range(halvings // 5):
        grid = {n: [a + (b - a) * k / 32 for k in range(1, 32)] for n, (a, b) in span.items()}
        wanted = [c.alias(f"{n}_{k}_{i}") for n, xs in grid.items() for k, x in enumerate(xs) for i, c in enumerate(tests[n][0](x))]
        row = sources.agg(*wanted).first()
        for n, xs in grid.items():
            columns, verdict, low = tests[n]
            passed = [verdict(x, *(row[f"{n}_{k}_{i}"] for i in range(len(columns(x))))) for k, x in enumerate(xs)]
            edge = next((k for k, ok in enumerate(passed) if ok != low), 31)
            a, b = span[n]
            span[n] = (a + (b - a) * edge / 32, a + (b - a) * (edge + 1) / 32)
    return {n: s[0] if tests[n][2] else s[1] for n, s in span.items()}


def exponent(sources: DataFrame, n: int, entropy: float | None, limit: float | None, keep_all: bool) -> float:
    """The exponent for the targets. sources: share (above 0)."""
    share, tests = F.col("share"), {}
    if entropy is not None:
        target = entropy * math.log(n)
        tests["entropy"] = (
            lambda x: (F.sum(F.pow(share, F.lit(x))), F.sum(F.pow(share, F.lit(x)) * F.log(share))),
            lambda x, z, s: math.log(z) - x * s / z >= target,
            True,
        )
    if limit is not None:
        tests["limit"] = (
            lambda x: (F.sum(F.pow(share, F.lit(x))), F.max(F.pow(share, F.lit(x - 1))), F.min(F.pow(share, F.lit(x - 1)))),
            lambda x, z, top, least: top / (least if keep_all else z) <= limit,
            False,
        )
    found = bisected(sources, tests)
    return round(min(1.0, max(found.get("entropy", 0.0), found.get("limit", 0.0) + 1e-6 * ("limit" in found))), 6)


def planned(documents: DataFrame, entropy: float | None = ENTROPY, limit: float | None = LIMIT, keep_all: bool = False, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, weight, copies, block and rank of every document: a source's permutation goes by block, then rank, then doc_id. keep_all: the budget is so large that no source gets less than one copy; else it is the tokens there are."""
    counted = stored(documents.select("doc_id", "source", n_tokens().alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("rank")))
    totals = stored(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    sums = totals.agg(F.sum("tokens").alias("tokens"), F.sum((F.col("tokens") > 0).cast("int")).alias("n")).first()
    if not sums["tokens"]:
        return counted.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("block"), "rank")
    sources = totals.withColumn("share", F.col("tokens") / F.lit(float(sums["tokens"])))
    x = exponent(sources.where("tokens > 0"), sums["n"], entropy, limit, keep_all)
    z = sources.where("tokens > 0").agg(F.sum(F.pow("share", F.lit(x))).alias("z"), F.min(F.pow("share", F.lit(x - 1))).alias("least")).first()
    budget = sums["tokens"] * (z["z"] / z["least"] if keep_all else 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(x)) / z["z"]).otherwise(0.0)
    plan = sources.withColumn("weight", F.round(weight, 9)).withColumn("budget", F.round(weight * F.lit(float(budget))).cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))
    plan = plan.select(F.col("source").alias("s"), "weight", "whole", "rest", F.ceil(F.col("docs") / BLOCK_ROWS).alias("blocks"))
    dealt = counted.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("rank", "blocks"))
    dealt = dealt.select("doc_id", "source", "n_tokens", "weight", "whole", "rest", "rank", "block")
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("block")) - F.col("held")
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), before.alias("before"), "held")
    placed = dealt.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = F.col("before") + F.col("held") <= F.col("rest")
    split = ~inside & (F.col("before") < F.col("rest"))
    plain = placed.where(~split).withColumn("extra", inside.cast("long"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("rank", "doc_id"))
    cut = placed.where(split).withColumn("extra", (F.col("before") + running <= F.col("rest")).cast("long"))
    copies = (F.col("whole") + F.col("extra")).cast("long").alias("copies")
    return plain.unionByName(cut).select("doc_id", "source", "n_tokens", "weight", copies, F.col("block").cast("long").alias("block"), "rank")


def mixed(documents: DataFrame, **targets) -> DataFrame:
    """``documents`` with each row as often as its plan says; rows that share an id get the largest number of copies that one of them has."""
    doc, copies, k = fresh(documents, "planned_doc", "planned_copies", "planned_copy")
    plan = planned(documents.select("doc_id", "source", "text"), **targets).groupBy(F.col("doc_id").alias(doc)).agg(F.max("copies").alias(copies))
    joined = documents.join(plan, F.col("doc_id").eqNullSafe(F.col(doc)))
    return joined.withColumn(k, F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies).cast("int"))))).select(*documents.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(table(spark, sf_dir, "documents"))

"""Connected groups of links, with DataFrame operations only.

Links are pairs of ids. Each round joins every vertex's neighbours to the smallest of them (large star, then small star,
as published for map-reduce), until no link changes; every round is written to the shared folder, so its lineage ends
there, and the round before is deleted. A vertex with very many links is a key of an aggregation with partial sums and of
a join that Spark can split; no group of links is ever gathered into a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import released, stored

#: Members of a bucket and class of sizes that make a group a crowd, how many of these are shown to others, how often, and the step of sizes.
CROWD, SHOWN, TURNS, CLASS = 16, 4, 3, 1.2


def shared_buckets(members: DataFrame) -> DataFrame:
    """(key, id, degree, first) of members (key, id) that share their bucket with others.

    degree: how many members the buckets of an id have together. first: the member of the bucket with the largest degree
    (then the least id). Among copies with edits of their own, the text that all were made from has the largest degree.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(sizes.hint("merge"), "key"))
    degrees = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = shared.drop("n").join(degrees.hint("merge"), "id")
    out = stored(ranked.join(_leaders(ranked, "first").hint("merge"), "key"))
    released(shared)
    return out


def _leaders(rows: DataFrame, name: str) -> DataFrame:
    """key, the id (``name``) of the row with the largest degree of each bucket, and its sketch if rows have one."""
    sketch = ["sketch"] if "sketch" in rows.columns else []
    top = rows.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("least"), *sketch)).alias("top"))
    return top.select("key", (-F.col("top.least")).alias(name), *(F.col("top.sketch").alias(f"{name}_sketch") for _ in sketch))


def star_pairs(rows: DataFrame, pivot: str, candidate: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Pairs (a, b), a < b, of each member with its bucket's pivot: ``n`` members give ``n - 1`` pairs at most."""
    star = rows.where(F.col("id") != F.col(pivot))
    if candidate is not None:
        star = star.where(candidate(F.col("sketch"), F.col(f"{pivot}_sketch")))
    return star.select(F.least("id", pivot).alias("a"), F.greatest("id", pivot).alias("b")).distinct()


def _with_distance(grouped: DataFrame, pivot: str, name: str, known: DataFrame) -> DataFrame:
    """``grouped`` with the distance of each id from its bucket's pivot, if that pair is known (a, b, distance)."""
    of = known.select(F.col("a").alias("a__"), F.col("b").alias("b__"), F.col("distance").alias(name))
    joined = grouped.join(of.hint("merge"), (F.least("id", pivot) == F.col("a__")) & (F.greatest("id", pivot) == F.col("b__")), "left").drop("a__", "b__")
    return joined.withColumn(name, F.when(F.col("id") == F.col(pivot), F.lit(0.0)).otherwise(F.col(name)))


def _stars(roots: DataFrame) -> DataFrame:
    """Links (a, b) that connect what (id, root) has in one group; groups of stars take few rounds."""
    return roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def _mixed(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets with several roots, stored, with root and main: the root that most rows of the bucket have."""
    rows = placed.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    many = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top"))
    return stored(rows.join(many.where("roots > 1").select("key", F.col("top.root").alias("main")).hint("merge"), "key"))


def _crowd_pairs(left: DataFrame, candidate: Callable[[Column, Column], Column], turn: int) -> DataFrame:
    """Pairs (a, b) of members with ``SHOWN`` of the largest group of their bucket and class of sizes, unless they are in it or it is no crowd."""
    rows = left.withColumn("class", F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(CLASS)))
    shown = [F.min(F.struct(F.xxhash64("id", F.lit(turn * SHOWN + k)).alias("h"), "id", "sketch")).alias(f"m{k}") for k in range(SHOWN)]
    crowds = rows.groupBy("key", "class", "root").agg(F.count("*").alias("n"), *shown).where(F.col("n") >= CROWD)
    top = crowds.groupBy("key", "class").agg(F.max(F.struct("n", F.col("root").alias("crowd"), F.array(*(f"m{k}" for k in range(SHOWN))).alias("shown"))).alias("top"))
    asked = rows.select("key", "class", "id", "root", "sketch").join(top.select("key", "class", "top.crowd", "top.shown").hint("merge"), ["key", "class"]).where("root <> crowd")
    pairs = asked.select("id", "sketch", F.explode("shown").alias("of")).where(candidate(F.col("sketch"), F.col("of.sketch")))
    return pairs.select(F.least("id", "of.id").alias("a"), F.greatest("id", "of.id").alias("b")).distinct()


def near_groups(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], reach: float | Column, candidate: Callable[[Column, Column], Column] | None = None,
    bounds: tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """(id, root) of ids in groups that near pairs of members (key, id) of one bucket connect.

    ``verify(pairs)`` gives (a, b, distance, near) of pairs (a, b) of ids; distance is a metric (null: not known), and
    ``near`` holds only for distances of at most ``reach`` (a number, or an expression of sizes ``size_1``, ``size_2`` that
    members bring as ``size``); a test ``candidate`` of the ``sketch`` that both bring can rule pairs out before. The
    groups are those of all pairs in every bucket, found with far fewer comparisons:

    1. each member with its bucket's first one, the pivot;
    2. members that aren't near to the pivot: the one of them with the largest degree is a second pivot for the bucket;
    3. where members bring ``size``: members of a bucket and class of sizes (a step of ``CLASS``) that aren't in the group that has
       the most of them, ``CROWD`` at least, with ``SHOWN`` of that group's members in the class, told off by hash, ``TURNS`` times. Most members near to
       any of a large group are near to one of these, so step 4 need not pair them with all;
    4. members of other groups than the one with most members in the bucket, by the links so far, with members of other groups
       than theirs, unless their distances from a pivot differ by more than ``reach`` (by the triangle inequality those are no near
       pairs), or what ``bounds`` tells rules them out. ``bounds`` has two functions: the first gives (id, bound) of rows (id, root),
       null for an id that can't be near to any id of another root; the second tells from two bounds whether their ids may be near.
       A pair comes from the least of the buckets that it shares, and once.
    """
    shared = shared_buckets(members)
    first = stored(verify(star_pairs(shared, "first", candidate)))
    near = first.where("near").select("a", "b", F.lit(True).alias("known"))
    ends = (F.least("id", "first") == F.col("a")) & (F.greatest("id", "first") == F.col("b"))
    outside = shared.where(F.col("id") != F.col("first")).join(near.hint("merge"), ends, "left").where("known IS NULL").select(*shared.columns)
    second = _leaders(outside, "second")
    apart = stored(outside.join(second.hint("merge"), "key"))
    pairs = star_pairs(apart, "second", candidate)
    more = stored(verify(pairs.join(first.hint("merge"), ["a", "b"], "left_anti")))
    known = first.unionByName(more)
    roots = components(known.where("near").select("a", "b"))
    rows = shared.join(second.select("key", "second").hint("merge"), "key")
    placed = stored(_with_distance(_with_distance(rows, "first", "d1", known), "second", "d2", known))
    released(shared, apart)
    left = _mixed(placed, roots)
    steps = [first, more]
    for turn in range(TURNS if "size" in members.columns and candidate is not None else 0):
        shown = stored(_crowd_pairs(left, candidate, turn).join(known.hint("merge"), ["a", "b"], "left_anti"))
        if shown.isEmpty():
            released(shown)
            break
        steps.append(stored(verify(shown)))
        known = known.unionByName(steps[-1])
        joined = components(_stars(roots).unionByName(steps[-1].where("near").select("a", "b")))
        released(shown, roots, left)
        roots, left = joined, _mixed(placed, joined)
    carried, temporary = left, [left]
    if bounds is not None:
        limits = stored(bounds[0](left.select("id", "root").distinct()))
        carried, temporary = left.join(limits.where("bound IS NOT NULL").hint("merge"), "id"), [left, limits]
    keys = carried.groupBy("id").agg(F.collect_list("key").alias("keys"))  # as many as an id has at most
    carried = stored(carried.join(keys.hint("merge"), "id"))
    names = ("key", "id", "root", "d1", "d2", "keys", *(c for c in ("size", "sketch", "bound") if c in carried.columns))
    side = lambda rows, k: rows.select(*(F.col(c).alias(f"{c}_{k}") for c in names), (F.col("root") == F.col("main")).alias(f"in_main_{k}"))
    possible = (F.col("key_1") == F.col("key_2")) & (F.col("root_1") != F.col("root_2"))
    for d in ("d1", "d2"):
        possible = possible & F.coalesce(F.abs(F.col(f"{d}_1") - F.col(f"{d}_2")) <= reach, F.lit(True))
    if candidate is not None:
        possible = possible & candidate(F.col("sketch_1"), F.col("sketch_2"))
    if bounds is not None:
        possible = possible & bounds[1](F.col("bound_1"), F.col("bound_2"))
    possible = possible & (F.col("key_1") == F.array_min(F.array_intersect("keys_1", "keys_2")))
    possible = possible & (F.col("in_main_2") | (F.col("id_1") < F.col("id_2")))  # pairs outside the main group would come twice
    both = side(carried.where("root <> main"), 1).join(side(carried, 2).hint("merge"), possible)
    pairs = both.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct()
    rest = stored(verify(pairs.join(known.hint("merge"), ["a", "b"], "left_anti")))
    released(placed, carried, *temporary)
    late = rest.where("near").select("a", "b")
    if late.isEmpty():
        released(*steps, rest)
        return roots
    out = components(_stars(roots).unionByName(late))
    released(*steps, rest, roots)
    return out


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) of every vertex of ``links`` (a, b), stored: root is the least id of its connected group."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        released(edges)
        edges = after
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links are not grouped after {rounds} rounds")
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    out.stored_at = edges.stored_at
    return out

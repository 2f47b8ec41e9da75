"""Hard negatives by inner product, from a vantage-point tree over norm-augmented vectors.

With M the largest norm, each vector gets one more component, sqrt(M^2 - norm^2), and an anchor gets 0 there: the squared
distance of an anchor to a vector is then its squared norm plus M^2 less twice their inner product. Higher scores are nearer,
and a window of scores is an annulus around the anchor. Distances to vantage points bound, by the triangle inequality, how
near and how far the vectors of a node can be, so nodes outside the annulus, or beyond the k found, are left out.

The top of the tree is built from ``SAMPLE`` rows at most and has ``LEAVES`` leaves at most; all rows go down it. The rows of
a leaf are dealt into blocks of about ``BLOCK`` rows by their ids, each with a tree of its own that splits by rank, so that
a third of all rows with one vector are as many blocks as needed. A search visits one block of the nearest leaf first, and then,
in the order of their distance, the nodes of all blocks whose leaf can hold anything nearer than what was found. Requests
travel in packs; blocks and packs are joined by block. All bounds are exact: leaving out nodes changes no result.

Defined results: rows whose id or label is null take no part, nor do null vectors, those with null or non-finite entries, and
those of another length than most rows have. Rows equal in id, label and vector are one row; rows that share an id only are
rows of their own, none of them a candidate for an anchor of that id. Ties go to smaller ids. Anchors without positives, and
positives without negatives in their window, have no rows; so have negative positive scores, whose window is empty. Scores
beyond 64 bits are an error. Further columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm.common import released, stored, table
from meshwright.llm.op12_whitening import common_length, matrix, usable

POSITIVES, NEGATIVES = 5, 10
SAMPLE, LEAVES, BLOCK, NODE, PACK = 4096, 64, 8192, 64, 256
SCALE = 256
FOUND = "request long, vec_id long, score long"


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """The components that bring all vectors to one squared norm."""
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def distances(p: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Distances of augmented vectors x to the augmented vectors p: a row for each of x."""
    gap = augmented(x, most)[:, None] - augmented(p, most)[None]
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T) + gap * gap
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """A complete binary tree: node k has the children 2k+1 and 2k+2. Each leaf has its nodes from the root on and the distances to their vantage points that its rows can have."""

    def __init__(self, x: np.ndarray, depth: int, most: float, rows: bool):
        """rows: keep the rows of each leaf and the distances they have; else split by thresholds, for any rows to come."""
        self.depth, self.most = depth, most
        self.vantage, self.limit = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
        self.path = np.zeros((2**depth, depth), np.int64)
        self.low, self.high = np.zeros((2**depth, depth)), np.full((2**depth, depth), np.inf)
        members = [np.arange(len(x))]
        for level in range(depth):
            split = []
            for k, of in enumerate(members):
                node, leaves = 2**level - 1 + k, 2 ** (depth - level)
                self.path[k * leaves : (k + 1) * leaves, level] = node
                if len(of):
                    far = distances(x[of[:1]], x[of], most)[:, 0].argmax()
                    self.vantage[node] = x[of[far]]
                d = distances(self.vantage[node : node + 1], x[of], most)[:, 0]
                order = d.argsort(kind="stable")
                half = len(of) // 2
                self.limit[node] = d[order[half - 1]] if half else 0.0
                sides = (order[:half], order[half:]) if rows else (np.flatnonzero(d <= self.limit[node]), np.flatnonzero(d > self.limit[node]))
                for s, at in enumerate(sides):
                    below = slice(k * leaves + s * leaves // 2, k * leaves + (s + 1) * leaves // 2)
                    lo, hi = (d[at].min(initial=np.inf), d[at].max(initial=0)) if rows else ((0, self.limit[node]), (self.limit[node], np.inf))[s]
                    self.low[below, level], self.high[below, level] = lo, hi
                    split.append(of[at])
            members = split
        self.members = members if rows else None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row goes down to."""
        node, far = np.zeros(len(x), np.int64), distances(self.vantage, x, self.most)
        for _ in range(self.depth):
            node = 2 * node + 1 + (far[np.arange(len(x)), node] > self.limit[node])
        return node - (2**self.depth - 1)

    def score_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and the lowest score that each anchor can have with any row of each leaf, with room for rounding."""
        norm = (q * q).sum(1) + self.most
        d = np.sqrt(np.maximum(norm[:, None] - 2 * (q @ self.vantage.T), 0))[:, self.path]
        near = np.maximum(self.low - d, d - self.high).max(2, initial=0)
        far = (d + self.high).min(2, initial=np.inf)
        room = 1e-9 * norm[:, None] + 1e-3
        return (norm[:, None] - near * near) / 2 + room, (norm[:, None] - far * far) / 2 - room


def first_k(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of each request, ties by smaller id."""
    order = np.lexsort((ids, -scores, who))
    starts = np.flatnonzero(np.diff(who[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def nearest(tree: Tree, block: dict, p: dict, rows: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, id, score) of the k best rows of a block for some requests of a pack, nodes taken nearest first, in steps of 1, 2, 4 and so on."""
    q, least, most, kth = p["x"][rows], p["low"][rows], p["high"][rows], p["kth"][rows].copy()
    label, anchor = p["label"][rows], p["anchor_id"][rows]
    top, bottom = tree.score_bounds(q.astype(float))
    wanted = (top >= least[:, None]) & (bottom <= most[:, None])
    order = np.argsort(-top, axis=1, kind="stable")
    who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)
    at, step = 0, 1
    while at < order.shape[1]:
        leaves = order[:, at : at + step]
        line = np.arange(len(rows))[:, None]
        i, j = np.nonzero(wanted[line, leaves] & (top[line, leaves] >= kth[:, None]))
        if not len(i) and not (wanted[line, order[:, at:]] & (top[line, order[:, at:]] >= kth[:, None])).any():
            break
        new = [(who, ids, scores)]
        chosen = leaves[i, j]
        for leaf in np.unique(chosen):
            of, m = i[chosen == leaf], tree.members[leaf]
            s = q[of] @ block["x"][m].T
            good = (s >= np.maximum(least, kth)[of, None]) & (s <= most[of, None]) & ((block["label"][m] == label[of, None]) == same) & (block["vec_id"][m] != anchor[of, None])
            a, b = np.nonzero(good)
            new.append((of[a], block["vec_id"][m[b]], s[a, b]))
        who, ids, scores = (np.concatenate(c) for c in zip(*new, strict=True))
        kept = first_k(who, ids, scores, k)
        who, ids, scores = who[kept], ids[kept], scores[kept]
        full = np.flatnonzero(np.bincount(who, minlength=len(rows)) == k)
        worst = np.full(len(rows), np.inf)
        np.minimum.at(worst, who, scores)
        kth[full] = np.maximum(kth[full], worst[full])
        at, step = at + step, 2 * step
    return p["request"][rows][who], ids, scores


class Index:
    """Rows in blocks with trees, the top of the tree, and how many blocks each of its leaves has."""

    def __init__(self, blocks: DataFrame, top: Tree, salts: dict[int, int], exact: type):
        self.blocks, self.top, self.salts, self.exact = blocks, top, salts, exact


def prepared(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and x (whole numbers as doubles) of the rows that take part."""
    lab = F.col(label).cast("int")
    changed = F.when(F.col(key) % 7 == 0, (lab + 1) % 10).otherwise(lab)
    rows = df.where(usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull())
    return rows.select(F.col(key).cast("long").alias("vec_id"), changed.alias("label"), F.transform(vector, lambda e: F.floor(F.lit(SCALE) * e.cast("double")).cast("double")).alias("x"))


def drawn_sample(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """x of the ``sample`` rows with the least hashes of their ids, or of all, if they are fewer.

    Each task sends its least rows to the driver, so those beyond a cut that some ``2 * sample`` of the ``n`` rows pass are left out
    before: what the driver gets doesn't grow with the number of tasks. Ids that many rows share can leave fewer, any rows if none.
    """
    least = F.xxhash64("vec_id")
    few = rows if n <= 2 * sample else rows.where(least < F.lit(-(1 << 63) + (1 << 64) * 2 * sample // n))
    if few is not rows and few.isEmpty():
        return rows.limit(sample).select("x")
    return few.orderBy(least, "vec_id").limit(sample).select("x")


def built(rows: DataFrame, dims: int, block: int = BLOCK, sample: int = SAMPLE, leaves: int = LEAVES) -> Index | None:
    """The index of rows (vec_id, label, x); None without rows. The sample, of at most ``sample`` rows, shapes the top only."""
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e)
    n, most = rows.agg(F.count("*"), F.max(square)).first()
    if not n:
        return None
    if most >= 2.0**62:
        raise ValueError("inner products go beyond 64 bits")
    exact = np.float64 if most < 2.0**52 else np.int64
    drawn = drawn_sample(rows, n, sample).collect()
    depth = max(0, math.ceil(math.log2(min(leaves, -(-n // block)))))
    top = Tree(np.array([r["x"] for r in drawn]), depth, most, rows=False)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = pa.array(top.leaf_of(matrix(b.column(2), dims)), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, leaf], names=["vec_id", "label", "x", "leaf"])

    routed = stored(rows.mapInArrow(down, "vec_id long, label int, x array<double>, leaf int"))
    salts = {r["leaf"]: -(-r["count"] // block) for r in routed.groupBy("leaf").count().collect()}  # of so many leaves at most
    many = F.create_map(*(F.lit(v) for pair in salts.items() for v in pair))[F.col("leaf")]
    dealt = routed.withColumn("block", F.shiftleft(F.col("leaf").cast("long"), 32) + F.pmod(F.xxhash64("vec_id"), many))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        x = matrix(rows["x"].combine_chunks(), dims)
        once = list({(i, lab, v.tobytes()): k for k, (i, lab, v) in enumerate(zip(ids.tolist(), labels.tolist(), x + 0.0, strict=True))}.values())
        ids, labels, x = ids[once], labels[once], x[once]
        tree = Tree(x, max(0, math.ceil(math.log2(len(x) / NODE))), most, rows=True)
        data = pickle.dumps((tree, {"vec_id": ids, "label": labels, "x": x.astype(exact)}))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([data], pa.binary())})

    blocks = stored(dealt.select("block", "vec_id", "label", "x").groupBy("block").applyInArrow(build, "block long, tree binary"))
    released(routed)
    return Index(blocks, top, salts, exact)


def search(index: Index, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """request, vec_id, score of the k best rows of each request: of its label (same) or of others, not of its anchor_id, and with low <= score <= high.

    requests: request (distinct), anchor_id, label, x, low, high. Two rounds: one block of the nearest leaf, then all else that can hold better rows.
    """
    top, salts, exact, dims = index.top, index.salts, index.exact, index.top.vantage.shape[1]
    there = np.array(sorted(salts))

    def read(b: pa.RecordBatch) -> dict:
        p = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("request", "anchor_id", "label", "low", "high", "kth")}
        p["x"] = matrix(b.column("x"), len(b.column("x").flatten()) // len(b))
        upper, lower = top.score_bounds(p["x"])
        nearest_leaf = there[upper[:, there].argmax(1)]
        p["home"] = (nearest_leaf << 32) + p["request"] % np.array([salts[v] for v in nearest_leaf.tolist()])
        p["wanted"] = (upper >= np.maximum(p["low"], p["kth"])[:, None]) & (lower <= p["high"][:, None])
        return p | {"x": p["x"].astype(exact)}

    def packs(first: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, PACK):
                    p = read(b.slice(at, PACK))
                    blocks = np.unique(p["home"]).tolist() if first else [(v << 32) + s for v in there[p["wanted"][:, there].any(0)].tolist() for s in range(salts[v])]
                    yield pa.RecordBatch.from_pydict({"blocks": pa.array([blocks], pa.list_(pa.int64())), "pack": pa.array([pickle.dumps(p)], pa.binary())})

        return run

    def visit(first: bool):  # noqa: ANN202
        def run(key: tuple, packs: pa.Table, trees: pa.Table) -> pa.Table:
            number, found = key[0].as_py(), [(np.zeros(0, np.int64),) * 3]
            tree, block = pickle.loads(trees["tree"][0].as_py()) if packs.num_rows and trees.num_rows else (None, None)
            for pack in packs["pack"] if tree else ():
                p = pickle.loads(pack.as_py())
                rows = np.flatnonzero(p["home"] == number if first else (p["home"] != number) & p["wanted"][:, number >> 32])
                if len(rows):
                    found.append(nearest(tree, block, p, rows, k, same))
            return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["request", "vec_id", "score"])

        return run

    def round_of(asked: DataFrame, first: bool) -> DataFrame:
        # requests that are near one another share packs, and so the blocks they visit
        packed = asked.select("request", "anchor_id", "label", "x", "low", "high", "kth").mapInArrow(packs(first), "blocks array<long>, pack binary")
        visits = packed.select(F.explode("blocks").alias("block"), "pack")
        # there are packs times blocks, which a join may take for few and send through the driver; and a block's tree comes once
        return visits.groupBy("block").cogroup(index.blocks.groupBy("block")).applyInArrow(visit(first), FOUND)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upper, _ = top.score_bounds(matrix(b.column("x"), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(there[upper[:, there].argmax(1)], pa.int32())], names=[*b.schema.names, "leaf"])

    sorted_ = requests.select("request", "anchor_id", "label", "x", "low", "high").mapInArrow(homes, "request long, anchor_id long, label int, x array<double>, low double, high double, leaf int")
    asked = stored(sorted_.repartitionByRange("leaf", "request").sortWithinPartitions("leaf", "request"))
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "vec_id"))
    one = stored(round_of(asked.withColumn("kth", F.lit(float("-inf"))), True))
    bound = one.groupBy("request").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("found"))
    two = round_of(asked.join(bound, "request", "left").withColumn("kth", F.coalesce("found", F.lit(float("-inf")))), False)
    best = stored(one.unionByName(two).withColumn("rank", rank).where(F.col("rank") <= k))
    released(asked, one)
    return best


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a distinct number each, written so that it stays."""
    return stored(rows.withColumn("request", F.monotonically_increasing_id()))


def mined(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows are (default: those whose id is divisible by 100)."""
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = prepared(df, key, vector, label)
    dims = common_length(rows, "x")
    rows = rows.where(F.size("x") == dims)
    index = built(rows, dims, block) if dims > 0 else None
    if index is None:
        return df.sparkSession.createDataFrame([], result)
    chosen = rows.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors)
    asked = numbered(chosen.distinct().withColumnRenamed("vec_id", "anchor_id").withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))}))
    found = search(index, asked, positives, same=True).select("request", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = {"low": F.ceil(F.col("positive_score") * 30 / 100).cast("double"), "high": F.floor(F.col("positive_score") * 90 / 100).cast("double")}
    pairs = asked.select("request", "anchor_id", "label", "x").join(found, "request").drop("request").withColumns(window).where("low <= high")
    pairs = numbered(pairs)
    best = search(index, pairs, negatives, same=False)
    done = best.join(pairs.select("request", "anchor_id", "positive_id", "positive_score"), "request")
    return done.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


#: Scores by brute force.
SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(v AS DOUBLE)) for v in embedding] AS x FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

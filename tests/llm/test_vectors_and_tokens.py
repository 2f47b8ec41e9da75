"""Hard negatives, whitening and token counts against brute force, on odd rows and on the small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import op11_negatives, op12_whitening, op13_tokens

VECTORS = "vec_id long, label int, embedding array<float>, source string, rank int, x string, request long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, None if v is None else [None if e is None else float(e) for e in v], "s", 7, "x", 1) for i, lab, v in rows], VECTORS).repartition(3)


def many_rows(n, dims, seed, hot=0.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[0] if r.random() < hot else centres[r.integers(6)] + 0.3 * r.normal(size=dims)
        out.append((i, int(r.integers(4)), (v / np.linalg.norm(v)).astype(np.float32).tolist() if hot or i % 3 else v.astype(np.float32).tolist()))
    return out


ODD = [
    (None, 1, [0.1] * 6), (700, None, [0.1] * 6), (800, 1, None), (900, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (1000, 1, [math.nan] * 6), (1100, 1, [math.inf] + [0.0] * 5), (1200, 1, [0.5] * 5), (1300, 2, []),
    (1400, 3, [0.0] * 6), (1500, 2, [-0.5] * 6), (1600, 2, [-0.5] * 6), (1600, 2, [-0.5] * 6), (1700, 1, [0.9, 0, 0, 0, 0, 0]), (1700, 2, [0, 0.9, 0, 0, 0, 0]),
]


def usable(rows, dims):
    return [(i, lab, v) for i, lab, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]


def negatives(rows, dims):
    """All of it by comparing every anchor with every row."""
    seen = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * float(np.float32(e))) for e in v)) for i, lab, v in usable(rows, dims) if i is not None and lab is not None}
    out = []
    for a, lab, v in seen:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, k) for i, k, w in seen if i != a)
        for s, p, _ in [t for t in scored if t[2] == lab][:5]:
            window = [t for t in scored if t[2] != lab and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "block"), [(many_rows(900, 6, 1) + ODD, 8192), (many_rows(900, 6, 1) + ODD, 90), (many_rows(700, 6, 2, hot=0.4), 60), (many_rows(150, 6, 3), 8192)])
def test_hard_negatives_against_all_pairs(spark, rows, block):
    got = op11_negatives.mined(vectors(spark, rows), block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(map(tuple, got.collect()))
    expected = negatives(rows, 6)
    assert sorted(x[:3] + x[4:] for x in found) == sorted(x[:3] + x[4:] for x in expected) and len(found) > 20
    assert found == expected


def test_sample_sends_the_driver_no_more_from_many_tasks(spark):
    """The rows of least hashes, of few more that pass the cut; repeated ids leave some rows at least."""
    rows = spark.range(20000).selectExpr("id AS vec_id", "1 AS label", "array(cast(id AS double)) AS x").repartition(40)
    drawn = op11_negatives.drawn_sample(rows, 20000, 50)
    before = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(50).select("x")
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, before.collect()))
    assert "Filter" in drawn._jdf.queryExecution().executedPlan().toString()
    passing = rows.where(F.xxhash64("vec_id") < F.lit(-(1 << 63) + (1 << 64) * 100 // 20000)).count()
    assert 50 <= passing <= 150
    for k in (1, 2, 3, 4):
        same = spark.range(1000).selectExpr(f"{k} AS vec_id", "1 AS label", "array(1.0D) AS x")
        assert 0 < op11_negatives.drawn_sample(same, 1000, 10).count() <= 10


def test_packs_of_anchors_are_not_broadcast(spark, monkeypatch):
    """Packs times blocks meet by exchange, whatever the tables' sizes let the planner think."""
    plans, keep = [], op11_negatives.stored
    monkeypatch.setattr(op11_negatives, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    op11_negatives.op11_hard_negatives(spark, "/root/testdata/sf0.01").count()
    visits = [p for p in plans if "pack#" in p]
    assert len(visits) == 4
    assert all("CoGroup" in p and "BroadcastHashJoin [block" not in p for p in visits)


def test_hard_negatives_of_nothing(spark):
    df = vectors(spark, ODD)
    assert op11_negatives.mined(df.limit(0)).collect() == [] and op11_negatives.mined(df.where("vec_id IS NULL")).collect() == []
    assert op11_negatives.mined(df.where("vec_id = 1400")).collect() == []
    assert op11_negatives.mined(vectors(spark, [(100, 1, []), (200, 1, [])])).collect() == []


def test_tree_bounds_hold():
    """No score lies outside what a leaf's distances allow, and the tree leaves out most rows of grouped vectors."""
    r = np.random.default_rng(5)
    x = np.floor(256 * (r.normal(size=(12, 8))[r.integers(12, size=3000)] + 0.05 * r.normal(size=(3000, 8))))
    most = float((x * x).sum(1).max())
    for tree in (op11_negatives.Tree(x, 5, most, rows=True), op11_negatives.Tree(x[:400], 3, most, rows=False)):
        leaves = [tree.members[k] for k in range(2**tree.depth)] if tree.members else [np.flatnonzero(tree.leaf_of(x) == k) for k in range(2**tree.depth)]
        assert sum(map(len, leaves)) == len(x)
        q = x[::37]
        upper, lower = tree.score_bounds(q)
        for k, of in enumerate(leaves):
            s = q @ x[of].T
            assert (s <= upper[:, [k]]).all() and (s >= lower[:, [k]]).all()
        assert (upper < (q @ x.T).max(1)[:, None]).mean() > 0.1


@pytest.mark.parametrize("rows", [many_rows(400, 9, 4, hot=0.3) + [(i, lab, v[:3] * 3 if v and len(v) == 6 else v) for i, lab, v in ODD], many_rows(300, 21, 5)])
def test_whitening_against_numpy(spark, rows):
    dims = len(rows[0][2])
    kept = [(i, v) for i, _, v in usable(rows, dims)]
    x = np.array([[math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:16], turn[:, ::-1][:, :16]
    for tile in (4, 16):
        out = op12_whitening.whitened(vectors(spark, rows), tile=tile).toPandas()
        assert len(out) == len(kept) * min(16, dims) and (out["n"] == n).all() and (out["identity_error"] < 1e-9).all()
        want = {}
        for (i, _), row in zip(kept, x, strict=True):
            want.setdefault(i, []).append((int(((n * row - sums) ** 2).sum()), (row - sums / n) @ turn / np.sqrt(values)))
        for (i, k), own in out.groupby([out["vec_id"].fillna(-1), "component"]):
            known = want[None if i == -1 else int(i)]
            assert sorted(own["deviation"]) == sorted(d for d, _ in known)
            assert sorted(abs(own["whitened"])) == pytest.approx(sorted(abs(w[k - 1]) for _, w in known), abs=1e-7)
            assert own["explained"].to_numpy() == pytest.approx(values[k - 1] / (centred**2).sum() * n)


def test_whitening_is_exact_far_from_the_mean_and_defined_without_spread(spark):
    assert op12_whitening.product(np.array([[2**40], [1]]), np.array([[2**41], [3]])) == [2**81 + 3]
    far = [(i, 1, [2.0**30 + i, -(2.0**30) + (i * i) % 7]) for i in range(64)]
    wide = spark.createDataFrame([(i, lab, v) for i, lab, v in far], "vec_id long, label int, embedding array<double>")
    out = op12_whitening.whitened(wide).toPandas()
    assert len(out) == 128 and (out["identity_error"] < 1e-6).all()
    assert op12_whitening.whitened(vectors(spark, [])).collect() == [] and op12_whitening.whitened(vectors(spark, [(1, 1, [0.5, 0.5])] * 3)).collect() == []
    line = op12_whitening.whitened(vectors(spark, [(i, 1, [i, i, 3]) for i in range(5)])).toPandas()
    assert set(line["component"]) == {1} and line["explained"].iloc[0] == pytest.approx(1)


def test_row_blocks_are_dealt_by_tile(spark):
    """Covariances summed by tiles are those of all rows at once, whatever the tasks are."""
    rows = many_rows(300, 10, 7)
    fit = op12_whitening.whole(vectors(spark, rows), "vec_id", "embedding").select("x").distinct().repartition(5).persist()
    n, sums = op12_whitening.moments(fit, 10)
    x = np.array([r["x"] for r in fit.collect()])
    assert n == len(x) and sums == x.sum(0).tolist()
    centre = [round(s / n) for s in sums]
    found = op12_whitening.tile_sums(op12_whitening.column_blocks(fit, centre, 3), 10, 3)
    assert (found.astype(np.int64) == (x - centre).T @ (x - centre)).all()


PIECES = [
    "a", "b", "Don't", "don't", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", " ", "　", "\x85", " ", "é", "日本", "1", "23", ".", "!?", "(", "_", "<|endoftext|>", "<|endof", "|>", "🙂", "́",
    "\x00", "\x1c", "²", "ß", "×",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [None, "", "x" * 50_000, "日" * 9_000, " " * 5_000, "\n" * 3_000 + "a", "long words " * 20_000, *("".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(6_000))]


def counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(op13_tokens.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_are_the_librarys(spark, texts):
    rows = [(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "no id here", "w", 1), (7, texts[7], "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, block int").repartition(3)
    out = op13_tokens.token_counts(df).collect()
    assert len(out) == len(rows)
    want = dict(enumerate(counts(texts)))
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), want[r["doc_id"]], want[r["doc_id"]] > 1024)
    assert [r["n_tokens"] for r in out if r["doc_id"] is None] == counts(["no id here"])
    assert op13_tokens.token_counts(df.limit(0)).collect() == []


def test_token_counts_of_small_blocks(spark, texts):
    """Blocks of few bytes: each distinct pre-token is counted once, and all blocks that have it get the count."""
    some = texts[:400]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    blocks = op13_tokens.frequencies(df, "doc_id", "text", None, 2_000).persist()
    assert blocks.count() > 8
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    pieces = op13_tokens.piece_counts(words, None)
    assert pieces.select(F.sum(F.size("codes"))).first()[0] == words.count() > words.select("word").distinct().count()
    for row in blocks.collect():
        codes, n = np.cumsum(op13_tokens.unpacked(row["codes"])), op13_tokens.unpacked(row["counts"])
        ends = np.cumsum(row["sizes"])
        for k, (i, size) in enumerate(zip(row["ids"], row["sizes"], strict=True)):
            own = codes[ends[k] - size : ends[k]]
            assert (np.diff(own) > 0).all() and (n > 0).all()
            if i == 6:
                assert {row["words"][c]: m for c, m in zip(own, n[ends[k] - size : ends[k]], strict=True)} == {"long": 1, "Ġwords": 20_000, "Ġlong": 19_999, "Ġ": 1}


def test_whole_tables(spark):
    for name in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet").collect()
        got = {r["doc_id"]: r["n_tokens"] for r in op13_tokens.op13_token_counts(spark, f"/root/testdata/{name}").collect()}
        assert got == dict(zip((d["doc_id"] for d in docs), counts([d["text"] for d in docs]), strict=True))


def test_negatives_query_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, op11_negatives.op11_hard_negatives(spark, "/root/testdata/sf0.01").collect())) == sorted(con.execute(op11_negatives.SQL).fetchall())

"""The corpus operators against brute force, round trips and held-out labels, on small tables and odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import groups, op1_html, op2_lines, op3_quality, op4_lm, op5_media, op6_minhash, op7_packing, op8_mixing, op9_rules, op10_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i} and" for i in range(60))
TEXTS = [
    None, "", "   \n \t", "a", "one two three four five six", "one two three four five six", BASE, BASE + " tail", BASE.replace("word7 ", "WORD7 "), "é ü ñ 日本 #$% a|b <c>\n" * 30,
    "same line of seven words is here\n" * 5 + "same line of seven words is hers\nother words stand in this last line", "long " * 30_000 + "end", "x" * 50_000, "Same line of seven words is here", "it's <|endoftext|> don't\x00",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 3}", None, 0.5, True, "w") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all", "en", "s1", 1, None, None, None), (4, TEXTS[4], "en", "s1", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(15)] + [(4, 1, 0), (99, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def words_of(text):
    return WORD.findall(text or "")


def test_empty_tables_and_odd_rows(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    for d, n in ((docs, len(TEXTS) + 2), (none, 0)):
        assert op5_media.media_digest(op5_media.media_columns(d)).count() == n
        assert op9_rules.quality_rules(d, labels).count() == n and op9_rules.quality_rules(d, no_labels).count() == n
        assert op8_mixing.planned(d).count() == n
        assert op2_lines.dedup_lines(d).count() == n
        assert op6_minhash.near_duplicates(d).select("doc_id").count() >= n
    for f in (op3_quality.quality, op10_toxicity.toxicity):
        for d, lab in ((docs, labels), (docs, no_labels), (none, labels)):
            out = f(d, lab).collect()
            assert len(out) == d.count() and all(0 <= r["score"] <= 1 for r in out)
    assert op7_packing.pack(none).count() == 0 and op7_packing.pack(docs).count() >= len(TEXTS) + 2


def test_media_round_trip(docs):
    got = {r["doc_id"]: r for r in op5_media.media_digest(op5_media.media_columns(docs)).collect() if r["doc_id"] is not None}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        media = op5_media.to_wav(payload)
        r = got[i]
        assert op5_media.from_wav(media) == payload and (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest())
    assert got[0]["feature"] == got[1]["feature"] and got[4]["feature"] == got[5]["feature"] and got[4]["feature"] != got[6]["feature"]
    whole = op5_media.fingerprint(op5_media.padded(TEXTS[11].encode()))
    assert len(whole[0]) > 0 and (np.diff(whole[0]) >= 0).all()


def test_media_columns_hold_what_is_digested(docs):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in op5_media.media_columns(docs).collect()}
    digest = op5_media.media_digest(op5_media.media_columns(docs)).collect()
    assert len(digest) == docs.count()
    for r in digest:
        kept = rows[r["doc_id"], r["n_bytes"]]
        assert r["media_sha256"] == hashlib.sha256(kept["media"]).hexdigest() and r["n_pairs"] == len(kept["pairs"]) and r["media_bytes"] == len(kept["media"])


def test_packing_is_a_partition_of_all_ids(docs):
    from tokenizers import Tokenizer

    rows = op7_packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    tokenizer, by = Tokenizer.from_file(op7_packing.default_tokenizer()), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_rule_counts_and_bounds(docs, labels, real):
    def brute(t):
        t = t or ""
        w, seen, dup = words_of(t), set(), 0
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    small, docs_, labels_ = real
    rows = [*docs.where("doc_id IS NOT NULL").collect(), *small.collect()]
    for d in (docs, small):
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        for r in op9_rules.text_stats(d).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])
    assert len(rows) > 200
    assert op9_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    tail = sum(math.comb(50, k) * (p := op9_rules.upper_bound(3, 50, 0.05)) ** k * (1 - p) ** (50 - k) for k in range(4))
    assert tail == pytest.approx(0.05, rel=1e-6)
    good, bad = np.array([990, 9, 1, 0]), np.array([10, 10, 40, 40])
    assert op9_rules.choose(good, bad, 0.02, 0.01) in (2, 3) and op9_rules.choose(good[:0], bad[:0], 0.02, 0.01) is None
    judged = op9_rules.quality_rules(docs_, labels_).join(labels_, "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() <= 0.04 * judged.where("quality = 1").count()


def test_near_duplicates_against_all_pairs(docs, real):
    for d in (real[1], docs.where("doc_id IS NOT NULL")):
        texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
        shingles = {i: collections.Counter(zip(*(re.sub("[A-Z]+", lambda m: m[0].lower(), t).split()[k:] for k in range(5)), strict=False)) for i, t in texts.items()}
        root = {i: i for i in texts}

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        holders, equal = collections.defaultdict(list), collections.defaultdict(list)
        for i, c in shingles.items():
            equal[texts[i]].append(i)
            for s in c:
                holders[s].append(i)
        pairs = {p for v in holders.values() if len(v) < 300 for p in itertools.combinations(sorted(v), 2)} | {(min(v[0], b), max(v[0], b)) for v in equal.values() for b in v[1:]}
        for a, b in pairs:
            union = sum((shingles[a] | shingles[b]).values())
            if texts[a] == texts[b] or (union and sum((shingles[a] & shingles[b]).values()) / union >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = {r["doc_id"]: r["class_id"] for r in op6_minhash.near_duplicates(d).collect()}
        assert got == {i: find(i) for i in texts}


def test_rows_that_share_an_id(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(1, near), (5, "quite another text of words that stand on their own here"), (5, near + " tail"), (None, near)]
    for order in (rows, rows[::-1]):
        found = op6_minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((str(r["doc_id"]), r["class_id"]) for r in found) == [("1", 1), ("5", 1), ("5", 5), ("None", 1)]


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    left, right = [], []
    for _ in range(150):
        a = [f"w{v}" for v in r.integers(0, 12, 40)] * 2
        b = a[: r.integers(10, 80)] + [f"v{v}" for v in r.integers(0, 12, 30)]
        left.append(" ".join(a).encode())
        right.append(" ".join(b).encode())
    words = op6_minhash.Words(left + right)
    first = op6_minhash.registers(300, *op6_minhash.shingle_counts(words))
    error = (first[:150] == first[150:]).mean(1) - op6_minhash.overlap(left, right)
    assert abs(error.mean()) < 0.015


def test_components_and_stars(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 3)], "a long, b long")
    assert {r["id"]: r["root"] for r in groups.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 1, 7: 1, 8: 1, 9: 1}
    assert groups.components(links.limit(0)).count() == 0


def test_large_groups_are_joined_without_all_their_pairs(spark):
    """A crowd of which the pivots know half: its members meet some of the crowd, not all of it; lines near to none stay alone."""
    asked, crowd = [], range(2, 202)
    linked = lambda a, b: b in crowd and (a == 1 and b % 2 == 0 or a in crowd and (a * 31 + b * 17) % 4 > 0)

    def verify(pairs):
        found = [(r["a"], r["b"]) for r in pairs.collect()]
        asked.extend(found)
        return spark.createDataFrame([(a, b, None, linked(a, b)) for a, b in found], "a long, b long, distance double, near boolean")

    rows = spark.createDataFrame([(7, i, 100, (100, 0)) for i in range(210)], "key long, id long, size int, sketch struct<size:int,simhash:long>")
    out = groups.near_groups(rows, verify, op2_lines.allowed(F.greatest("size_1", "size_2"), 0.8), op2_lines.possible(0.8))
    assert {r["id"]: r["root"] for r in out.collect()} == dict.fromkeys(range(1, 202), 1)
    assert len(asked) == len(set(asked)) < 3500  # 210 * 209 / 2 pairs are 21945


def test_bounds_of_letters_rule_out_no_near_lines(spark):
    r = np.random.default_rng(9)
    lines = ["".join(r.choice(list("abcde é0"), int(r.integers(5, 40)))).strip() or "a" for _ in range(60)]
    lines += [x[: int(r.integers(0, 3))] + x[int(r.integers(2, 6)) :] + "z" * int(r.integers(0, 4)) for x in lines]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, norm string").withColumn("letters", op2_lines.letters("norm"))
    of, test = op2_lines.bounded(frame, 0.8)
    own = of(frame.select("id", F.lit(1).alias("root"))).join(frame.select("id", "norm"), "id")
    pairs = own.toDF("a", "x", "u").crossJoin(own.toDF("b", "y", "v")).where("a < b").withColumn("d", F.levenshtein("u", "v"))
    near = pairs.withColumn("near", F.col("d") <= op2_lines.allowed(F.greatest(F.length("u"), F.length("v")), 0.8)).withColumn("may", test(F.col("x"), F.col("y")))
    n = near.groupBy("near", "may").count().collect()
    n = {(r["near"], r["may"]): r["count"] for r in n}
    assert n[True, True] > 20 and (True, False) not in n and n[False, False] > 1000


def test_lines_keep_one_of_each_group(docs, spark):
    out = {r["doc_id"]: r for r in op2_lines.dedup_lines(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert out[10]["text"].count("is here") == 1 and out[10]["n_removed"] >= 4  # equal lines always; an edited one if its blocks agree
    assert out[13]["text"] == "" and out[3]["text"] == "a" and out[0]["text"] == ""
    assert out[4]["text"] == TEXTS[4] and out[5]["text"] == ""
    hashed = op2_lines.simhashes(spark.createDataFrame([(1, "a b c d e " * 100), (2, "a b c d e")], "id long, norm string").withColumn("norm", F.trim("norm")))
    assert len({r["simhash"] for r in hashed.collect()}) == 1


def test_short_lines_take_part(spark):
    texts = ["Les.\n* * *\n\n一二三四五六七八九十\nAll rights reserved.", "les\n* * *\n \n一二三四五六七八九十\nkept\n-----", "All rights reserved\n#####\n\n"]
    out = {r["doc_id"]: r for r in op2_lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]["text"] for i in range(3)] == [texts[0], " \nkept\n-----", "#####\n\n"]
    assert [out[i]["n_removed"] for i in range(3)] == [0, 3, 1]


def test_edited_lines_are_found(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    r = np.random.default_rng(4)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnop"), n))
    lines = [" ".join(word(r.integers(1, 8)) for _ in range(r.integers(5, 16))) for _ in range(40)]
    for x in list(lines):  # words and letters changed, left out and put in, at both ends and between
        w = x.split()
        for k in range(3):
            at = int(r.integers(0, len(w)))
            lines.append(" ".join([w[:at] + w[at + 1 :], w[:at] + [word(3)] + w[at:], w[:at] + [w[at][:-1] + "z"] + w[at + 1 :]][k]) or "a")
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    every = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if b - 40 in range(3 * a, 3 * a + 3) or (a + b) % 17 == 0]
    pairs = {(p["a"], p["b"]) for p in op2_lines.compared(spark.createDataFrame(every, "a long, b long"), frame, 0.8).where("near").collect()}
    near = lambda x, y: distance(x, y) <= math.floor(0.2 * max(len(x), len(y)) + 1e-9)
    assert pairs == {(a, b) for a, b in every if near(lines[a], lines[b])} and len(pairs) > 60
    texts = []
    for n in (5, 6, 8, 10, 12, 20, 40) * 20:  # one word of five letters redrawn, or a letter of one word
        line = [word(5) for _ in range(n)]
        edited, at = list(line), int(r.integers(0, n))
        edited[at] = word(5)
        texts += [" ".join(line), " ".join(edited), " ".join("q" + w[1:] if k == at else w for k, w in enumerate(line))]
    found = op2_lines.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert found.count() >= 0.98 * 2 * len(texts) / 3


def test_bounds_of_distances_change_no_verdict(spark):
    """Pairs at and around the allowed distance, long and short, with ends shifted; lines that aren't near are mostly told from their letters or beginnings."""
    r = np.random.default_rng(5)
    text = lambda n, letters="abcdefgh é0": "".join(r.choice(list(letters), n)).strip() or "a"
    lines, pairs = [], []
    for n in (12, 60, 300, 700):
        for k in range(12):
            a = text(n)
            b = list(a)
            for _ in range(int(n * 0.017 * (k + 1))):  # up to 0.2 of the letters, in two thirds of the line or all over it
                at = int(r.integers(0, len(b) if k % 2 else max(1, 2 * len(b) // 3)))
                b[at : at + int(r.integers(0, 2))] = list(text(int(r.integers(1, 3))))
            for other in ("".join(b), text(6 * n // 7)[:n // 7] + a[: 6 * n // 7], text(n), text(n, "stuvwxyz")):
                pairs.append((len(lines), len(lines) + 1))
                lines += [a, other]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    asked = spark.createDataFrame(pairs, "a long, b long")
    got = {(p["a"], p["b"]): p["near"] for p in op2_lines.compared(asked, frame, 0.8).collect()}
    sizes = asked.join(frame.toDF("a", "x"), "a").join(frame.toDF("b", "y"), "b")
    want = {(p["a"], p["b"]): p["d"] <= math.floor(0.2 * max(len(p["x"]), len(p["y"])) + 1e-9) for p in sizes.withColumn("d", F.levenshtein("x", "y")).collect()}
    assert got == want and 20 < sum(want.values()) < len(want) - 20
    counted = frame.select("norm", op2_lines.letters("norm").alias("n")).collect()
    assert all(sum(c["n"]) == len(c["norm"]) and c["n"][0] == c["norm"].count("a") for c in counted)


def test_line_links_against_all_pairs(real):
    """Links of lines in the tables: pairs that share a run of eight characters and are near by all-pairs comparison."""
    duckdb = pytest.importorskip("duckdb")
    docs = real[0].select("doc_id", "text")
    lines = docs.select(F.explode(op2_lines.normalised_lines(F.col("text"))).alias("norm")).where("norm <> ''").select(F.xxhash64("norm").alias("id"), "norm").distinct()
    frame = lines.toPandas()  # noqa: F841
    sql = "SELECT a.id AS a, b.id AS b FROM frame a JOIN frame b ON a.id < b.id AND abs(length(a.norm) - length(b.norm)) <= 0.2 * greatest(length(a.norm), length(b.norm)) AND length(a.norm) BETWEEN 10 AND 1500 AND length(b.norm) BETWEEN 10 AND 1500 AND jaccard(left(a.norm, 1500), left(b.norm, 1500)) > 0.5 AND levenshtein(a.norm, b.norm) <= floor(0.2 * greatest(length(a.norm), length(b.norm)) + 1e-9)"
    links = duckdb.sql(sql).fetchall()
    root = {r["id"]: r["root"] for r in op2_lines.line_groups(docs)[1].collect()}
    assert links and sum(root.get(a, a) == root.get(b, b) for a, b in links) >= 0.9 * len(links)


def test_removals_go_by_text_and_names_may_clash(spark):
    rows = [(1, "the same line of words is here\nother"), (4, "only this document has such words inside\nx"), (4, "the same line of words is here\ny"), (None, "the same line of words is here\nz")]
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, gone int, parts int, n_lines int, GONE_DOC int")
    out = op2_lines.dedup_lines(frame)
    assert out.columns == ["doc_id", "text", "gone", "parts", "GONE_DOC", "n_lines", "n_removed"]
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in out.collect()) == [("1", rows[0][1], 0), ("4", rows[1][1], 0), ("4", "y", 1), ("None", "z", 1)]


def test_mixing_meets_its_targets(docs, real):
    plan = op8_mixing.planned(real[1]).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("u"), F.max("weight").alias("w")).toPandas()
    assert plan.w.sum() == pytest.approx(1, abs=1e-6) and -(plan.w * np.log(plan.w)).sum() >= 0.99 * math.log(len(plan)) - 1e-6
    assert ((plan.w * plan.t.sum() - plan.u) >= -1).all() and (plan.u / plan.t).max() <= 4
    kept = op8_mixing.planned(docs, entropy=None, limit=2.0, keep_all=True)
    assert kept.agg(F.min("copies")).first()[0] >= 1
    again = op8_mixing.mixed(docs, entropy=None, limit=2.0, keep_all=True)
    clash = docs.withColumns({"planned_doc": F.lit(1), "planned_copy": F.lit(7)})
    assert op8_mixing.mixed(clash, entropy=None, limit=2.0, keep_all=True).agg(F.min("planned_copy"), F.max("planned_copy")).first()[:] == (7, 7)
    rows = op8_mixing.planned(real[1]).toPandas().sort_values(["block", "rank", "doc_id"])
    for _, of in rows[rows.n_tokens > 0].groupby("source", dropna=False):  # a permutation's prefix is taken: block by block, by rank inside the block that it ends in
        extra = (of.copies - of.copies.min()).to_numpy()
        assert set(extra) <= {0, 1} and (np.diff(extra) <= 0).all()
    assert again.columns == docs.columns and again.count() >= docs.count()


def test_html_on_pages_of_its_own_kind_and_odd_ones():
    learnt = op1_html.potentials()
    wrong = total = 0
    for p in op1_html.labelled_pages(40, seed=77):
        tree = op1_html.Tree(p)
        content = op1_html.Forest([tree]).marginals(*learnt)[0]
        total += len(tree.leaves)
        wrong += sum((content[k] >= 0.5) != (tree.marks[k] == "content") for k in tree.leaves)
    assert wrong <= 0.02 * total
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A title of it</h1><p>Fish &amp; chips,\n  with <b>peas</b>.<br><p>More text follows here, and then some.</article><footer>&copy; us</footer>"
    assert op1_html.extract([page, "", "<p", "plain words only"], learnt)[:3] == ["A title of it\nFish & chips, with peas.\nMore text follows here, and then some.", "", ""]
    # message passing against sums over all states
    tree = op1_html.Tree("<div><p>One two three.</p><ul><li>x</li></ul></div>")
    forest = op1_html.Forest([tree])
    unary, edge = learnt
    own = np.bincount(forest.row, unary[forest.column], len(forest.parent))
    weights = np.zeros(len(own))
    for states in itertools.product((0, 1), repeat=len(own)):
        e = sum(own[i] * states[i] for i in range(len(own))) + sum(edge[forest.kind[i], states[forest.parent[i]], states[i]] for i in range(1, len(own)))
        weights = np.vstack([weights, np.array([math.exp(e), *(math.exp(e) * np.array(states[1:]))])])
    total = weights.sum(0)
    assert forest.marginals(unary, edge)[0][1:] == pytest.approx(total[1:] / total[0])


def test_html_of_bare_and_deep_pages_and_odd_rows(spark):
    alone = "<article><p>A bare fragment with one paragraph of text, and nothing else at all.</p></article>"
    listed = "<nav><a href='/'>Home</a> <a href='/b'>About</a></nav><article><h1>Title of it</h1><dl><dt>Term</dt><dd>Its meaning is explained in this place.</dd></dl><p>Some more text of the article, long enough to be read.</p></article><footer>&copy; 2020 All rights reserved.</footer>"
    deep = "<div>" * 20_000 + alone + "</div>" * 20_000
    long = "<article>" + "<p>Words of a very long page, that goes on and on.</p>" * 100_000 + "</article>"
    rows = [(1, alone), (2, listed), (3, None), (4, ""), (5, deep), (6, long), (1, alone), (None, alone), (7, "<ul><li>x</b></i></ul></p></div>")]
    frame = spark.createDataFrame([(i, "u", h, 1, 2) for i, h in rows], "page_id long, url string, html string, page int, text int")
    got = op1_html.main_text(frame).collect()
    found = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and found[1] == found[None] and found[1].startswith("A bare fragment") and found[3] == found[4] == ""
    assert found[2].split("\n") == ["Title of it", "Term", "Its meaning is explained in this place.", "Some more text of the article, long enough to be read."]
    assert found[6].count("\n") == 99_999 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert op1_html.main_text(frame.limit(0)).count() == 0


def test_classifiers_on_held_out_labels(real):
    _, docs, labels = real
    for f, column, share in ((op3_quality.quality, "quality", 0.97), (op10_toxicity.toxicity, "toxic", 0.9)):
        judged = f(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", column).collect()
        assert sum(r["predicted"] == r[column] for r in judged) >= share * len(judged)


def test_gradients():
    r = np.random.default_rng(0)
    x, first, y = r.normal(size=(7, op3_quality.N_FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    net = op3_quality.Network(x, first, y, steps=0)
    loss = lambda: -np.mean(y * np.log(net._forward(x, first)["p"]) + (1 - y) * np.log(1 - net._forward(x, first)["p"]))
    for k, g in net._slopes(x, first, y).items():
        w, at = net.w[k], tuple(0 for _ in net.w[k].shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], abs=1e-6)
        w[at] = old


def test_language_model(docs, real):
    d = docs.unionByName(real[0], allowMissingColumns=True)
    rows = op4_lm.lm_scores(d).collect()
    texts = [(r["doc_id"], [*words_of(re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or "")), None]) for r in d.collect()]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in texts if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3)) for i, ws in texts)
    got = collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows)
    assert got == want and all(r["score"] < 0 for r in rows)


def small_model():
    r = np.random.default_rng(2)
    counts = np.zeros(op4_lm.END + 1, np.int64)
    counts[r.integers(0, op4_lm.BEGIN, 400)] = r.integers(1, 50, 400)
    counts[op4_lm.END] = 30
    around = np.zeros((len(counts), 2 * (op4_lm.OWN_CLASS + 1)), np.int64)
    seen = np.flatnonzero(counts)
    around[seen[:, None], r.integers(0, around.shape[1], (len(seen), 6))] += 3
    return op4_lm.Attention(op4_lm.Vocabulary(counts, around)), seen[seen < op4_lm.BEGIN]


def test_language_model_gradients_and_attention():
    net, seen = small_model()
    r = np.random.default_rng(5)
    net.w = {k: w.astype(float) + r.normal(0, 0.1, w.shape) for k, w in net.w.items()}
    texts = [r.choice(seen, n) for n in (3, 20, 70)]
    inputs, targets = net._pairs(texts)

    def loss() -> float:
        """The mean negative log-likelihood, position by position."""
        w, total, n = net.w, 0.0, 0
        for row, goal in zip(inputs, targets, strict=True):
            x = w["E"][row]
            for k, t in enumerate(goal):
                if t < 0:
                    continue
                at = op4_lm.STRIDE + k
                s = np.array([x[at] @ w["q"] @ (x[j] @ w["k"]) * op4_lm.HEAD**-0.5 + w["r"][at - j] for j in range(at + 1)])
                a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
                z = np.concatenate([x[at], sum(p * (x[j] @ w["v"]) for j, p in enumerate(a))])
                o = np.tanh(z @ w["1"] + w["b"]) @ w["2"] + w["c"]
                total, n = total - o[t] + np.log(np.exp(o - o.max()).sum()) + o.max(), n + 1
        return total / n

    before = loss()
    for k, g in net.slopes(inputs, targets).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-4
        up = loss()
        net.w[k][at] = old - 1e-4
        assert (up - loss()) / 2e-4 == pytest.approx(g[at], rel=0.02, abs=1e-5), k
        net.w[k][at] = old
    inside = net.score(texts, net.tables())
    flat = np.concatenate([np.concatenate([t, [op4_lm.END]]) for t in texts])
    prev = np.concatenate([np.concatenate([[op4_lm.BEGIN], t]) for t in texts])
    classes = inside - net.v.share[flat, net.v.near[prev]]
    assert -classes.mean() * math.log(10) == pytest.approx(before, rel=1e-3)


def test_language_model_probabilities_of_all_next_ids_sum_to_one():
    net, seen = small_model()
    start = np.random.default_rng(6).choice(seen, 19)
    ids = [k for k in range(op4_lm.END + 1) if k != op4_lm.BEGIN]
    total = 0.0
    for lo in range(0, len(ids), 2000):
        texts = [np.append(start, k) for k in ids[lo : lo + 2000]]
        total += (10.0 ** net.score(texts, net.tables())[len(start) :: len(start) + 2]).sum()
    assert total == pytest.approx(1, abs=0.02)  # no text has the begin id


def test_language_model_without_rows_or_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op4_lm.lm_scores(none).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = op4_lm.lm_scores(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 and r["base_score"] == 0 for r in rows)


def test_language_model_counts_every_word(real, monkeypatch):
    scores = lambda: {r["doc_id"]: r for r in op4_lm.lm_scores(real[0]).collect()}
    whole = scores()
    monkeypatch.setattr(op4_lm, "FREQUENT", 20)
    for i, r in scores().items():
        assert r["n_known"] == whole[i]["n_known"] and r["base_score"] == pytest.approx(whole[i]["base_score"], abs=1e-5)


def test_pipeline_keeps_its_contract(spark, real):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    docs = real[0]
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, docs, "/root/testdata/sf0.001"))
        assert after.columns == list(p.COLUMNS) and after.count() > 0
        if name in ("quality", "near_duplicates"):
            assert after.exceptAll(docs.select(*p.COLUMNS)).isEmpty()
        if name == "mixing":
            assert after.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        docs = after
    pieces = p.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").agg(F.sum("length").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert pieces["d"] == docs.select("doc_id").distinct().count() and pieces["n"] > 0


def test_pipeline_against_brute_force(spark, real):
    """run() on the smallest table: packed are the documents that brute force keeps of the groups of near copies, each whole."""
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    good = p.stored(p.quality_stage(spark, real[0], folder))
    lined = p.stored(p.line_stage(spark, good, folder)).toPandas()
    norm = lambda x: " ".join(re.sub(r"[^\w]|_", " ", re.sub(r"\d", "0", x.lower())).split())
    lines = [n for t in lined.text for n in map(norm, t.split("\n")) if n]
    assert len(lines) == len(set(lines))
    texts = [t.encode() for t in lined.text]
    root = list(range(len(texts)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(texts)):
        for j in np.flatnonzero(op6_minhash.overlap([texts[k]] * k, texts[:k]) >= 0.8) if k else []:
            root[find(k)] = find(int(j))
        for j in range(k):
            if texts[j] == texts[k]:
                root[find(k)] = find(j)
    want = {min(lined.doc_id[j] for j in range(len(texts)) if find(j) == find(k)) for k in range(len(texts))}
    pieces = p.run(spark, folder).toPandas()
    assert set(pieces.doc_id) == want
    whole = pieces.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (whole.n % whole.t == 0).all() and (whole.n >= whole.t).all()  # as many copies as the mixture has, each whole


def test_pipeline_on_empty_tables_and_clashing_names(spark, real):
    import corpus_pipeline as p

    clash = real[0].withColumns({"gone": F.lit(1), "text__": F.lit(2), "n_removed": F.lit(3)})
    for docs in (real[0].limit(0), clash.where("doc_id < 20")):
        for _, stage in p.STAGES[:-1]:
            docs = p.stored(stage(spark, docs, "/root/testdata/sf0.001"))
            assert docs.columns == list(p.COLUMNS)
        p.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count()


def test_pipeline_judges_rows_without_ids(spark, real):
    import corpus_pipeline as p

    near = " ".join(f"w{i}" for i in range(100))
    rows = [(None, near), (None, near), (None, near + " tail"), (7, BASE), (None, BASE + " tail"), (None, "on its own"), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in p.near_stage(spark, frame, "").collect()]
    assert sorted(map(repr, kept[:])) == sorted(map(repr, [(None, next(t for _, t in kept if t and t.startswith("w0"))), (7, BASE), (None, "on its own"), (None, None)]))
    twice = real[0].unionByName(real[0].withColumn("doc_id", F.lit(None).cast("long"))).select(*p.COLUMNS)
    after = p.quality_stage(spark, twice, "/root/testdata/sf0.001").groupBy("text").agg(F.count("doc_id").alias("a"), F.count("*").alias("n"))
    assert after.count() > 0 and after.where("n <> 2 * a").isEmpty()


def test_language_model_learns_from_all_texts(spark, real, monkeypatch):
    monkeypatch.setattr(op4_lm, "SAMPLE", 2)
    docs = real[0].select("doc_id", "text").where("doc_id < 60").toPandas()
    free = spark.createDataFrame(docs).where(~op4_lm.held_out("doc_id", 7, 2))
    first = {r["doc_id"] for r in free.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2).collect()}
    held = set(docs.doc_id) - {r["doc_id"] for r in free.collect()}
    turned = docs.assign(text=[t if i in first | held else " ".join((t or "").split()[::-1]) for i, t in zip(docs.doc_id, docs.text, strict=True)])
    one, two = ({r["doc_id"]: r for r in op4_lm.lm_scores(spark.createDataFrame(d)).collect()} for d in (docs, turned))
    assert held and all(one[i]["base_score"] == two[i]["base_score"] for i in held)
    assert any(one[i]["score"] != two[i]["score"] for i in held)  # word order of texts outside the sample

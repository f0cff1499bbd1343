"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscape.llm import manifest, negatives, rules

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, anchor_id long, score double, row string"


def plain_negatives(rows):
    """All pairs of (id, vector, label), in Python integers."""
    bad = lambda v: v is None or any(x is None or x != x or x in (float("inf"), float("-inf")) for x in v)
    kept = [(i, [int(np.floor(256.0 * x)) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and not bad(v)]
    out = []
    for k, (a, va, ya) in enumerate(kept):
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(va, v)), i, y) for j, (i, v, y) in enumerate(kept) if j != k]
        for p, pid, _ in sorted(s for s in scored if s[2] == ya)[:5]:
            held = sorted((s, i) for s, i, y in scored if y != ya and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a, pid, rank, nid, -p, -s) for rank, (s, nid) in enumerate(held, 1)]
    return sorted(out)


def mined(df):
    rows = negatives.usable(df)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = negatives.mined(rows, F.col("id") % 100 == 0)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    monkeypatch.setattr(negatives, "BLOCKS_A_TASK", 2)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(int(i), (centres[i % 12] + rng.normal(0, 0.05, 8)).tolist(), int(rng.integers(0, 10))) for i in range(600)]
    rows += [(i, [1.0] * 8, int(i % 3)) for i in range(1000, 1120)]  # copies, with ties
    rows += [(2100, None, 1), (2200, [1.0, None] + [0.0] * 6, 1), (2300, [float("nan")] * 8, 1), (2400, [float("inf")] * 8, 2), (2500, [1.0] * 8, None), (None, [1.0] * 8, 1), (2600, [], 1), (2700, [2.0, 1.0], 3), (-100, [0.5] * 8, 4), (300, rows[300][1], rows[300][2])]
    rng.shuffle(rows := [tuple(r) for r in rows])
    df = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], VECTORS).repartition(3)
    want = plain_negatives(rows)
    assert mined(df) == want and len(want) > 100
    assert mined(df.limit(0)) == []


def test_negatives_of_huge_components(spark):
    rows = [(100, [1e12, -3.0], 1), (1, [1e12, 5.0], 1), (2, [9e11, 1.0], 2), (3, [-1e300, 1.0], 2), (4, [8.1e11, 0.0], 3)]
    df = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], VECTORS)
    got = mined(df)
    # Scores that stop at the end of 64 bits are equal, and smaller ids come first.
    assert [(g[0], g[1], g[3]) for g in got] == [(100, 1, 2), (100, 1, 4)]


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (6, 32))
    a = np.floor(np.repeat(centres, 20, axis=0) + rng.normal(0, 2, (120, 32))).astype(np.int64)
    c = np.floor(np.tile(centres, (50, 1)) + rng.normal(0, 2, (300, 32))).astype(np.int64)
    parent, edge = negatives.spanning_tree(a)
    assert sum(map(len, negatives.levels_of(parent))) == len(a)
    exact = a @ c.T
    top = np.sort(exact, axis=1)[:, -5].astype(float)
    scorer, asked = negatives.Scores(a, c), []
    of, pairs = scorer.of, scorer.pairs
    scorer.of = lambda x: (asked.append(len(x) * len(c)), of(x))[1]
    scorer.pairs = lambda x, y: (asked.append(len(x)), pairs(x, y))[1]
    scores, known = scorer.within(parent, edge, top, np.full(len(a), np.inf), np.ones(exact.shape, bool), dense=0.5)
    assert (known | (exact < top[:, None])).all() and (scores[known] == exact[known]).all()
    assert sum(asked) < 0.4 * exact.size


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_rule_statistics_equal_plain_ones(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b c", "a a a a", "x\ny\nx\n\n x\nx", "é ü z | | $", "one two three one two three four"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "é", " ", "\x0b"]) for _ in range(rng.randrange(200))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 3, "y", [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string, votes array<int>")
    got = {r.doc_id: r for r in rules.judged(df)[0].collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(t), repr(t)
    assert rules.judged(df.limit(0))[0].count() == 0
    long = spark.createDataFrame([(1, "w1 w2 w3 w4 " * 300_000), (1, "w1 w2 w3 w4 " * 300_000), (None, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.n_repeat_words) for r in rules.judged(long)[0].collect()} == {(1, 1_200_000), (None, 0)}


def test_rules_recover_planted_accuracies(spark):
    """Votes drawn from known chances: EM finds classes and accuracies without labels, and the column equals the model."""
    rng = np.random.default_rng(2)
    n, right = 4000, np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9])
    good = rng.random(n) < 0.8
    votes = np.where(rng.random((n, 6)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random((n, 6)) < 0.2] = rules.ABSTAIN
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.fit(kinds, counts.astype(float))
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95
    assert np.abs(model.accuracies() - right).max() < 0.05 and abs(model.share - 0.8) < 0.04
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(votes[:50])], "i int, votes array<tinyint>")
    got = [r.p for r in df.select("i", rules.posterior(F.col("votes"), model).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, model.posterior(votes[:50]))
    assert rules.accuracy_table(spark, model, rules.RULES[:6]).count() == 6
    with pytest.raises(ValueError):
        rules.voted(df, rules.RULES + rules.RULES)


def test_rules_keep_good_documents(spark):
    got = rules.op12_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("q")), "doc_id").filter("not base_failed")
    assert got.filter("q = 1 and kept").count() >= 0.98 * got.filter("q = 1").count()
    assert got.filter("q = 0 and not kept").count() >= 0.9 * got.filter("q = 0").count()


def plain_manifest(rows):
    """Digests of (doc_id, source, lang, n_chars, text) without kept states: every node and every fold from its whole run."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    key = lambda s: (s is not None, (s or "").encode())
    order = sorted(rows, key=lambda r: (key(r[1]), r[0] is not None, r[0] or 0, leaf(r)))
    sources = sorted({r[1] for r in rows}, key=key)
    trees = {s: climb([leaf(r) for r in order if r[1] == s]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])

    def walk(levels, at, value):
        sibs = []
        for nodes in levels[:-1]:
            first = at // 3 * 3
            run = nodes[first : first + 3]
            sibs += run[: at - first] + run[at - first + 1 :]
            value, at = h(*run[: at - first], value, *run[at - first + 1 :]), at // 3
        return sibs, value

    out, place = [], {}
    for r in order:
        k = place[r[1]] = place.get(r[1], -1) + 1
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        start = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
        below, value = walk(trees[r[1]], k, start)
        above, value = walk(top, sources.index(r[1]), value)
        out.append((r[0], leaf(r), trees[r[1]][-1][0], top[-1][0], h(*below, *above), value, value == top[-1][0]))
    return sorted(out, key=str)


def manifested(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = manifest.leaves(df, changes={"text": F.translate("text", "\n", "")}, where=tampered)
    got = manifest.manifest(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_whole_runs(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(i, rng.choice([None, "", "a", "b", "é", "Z"]), rng.choice(["en", None]), rng.choice([None, 7, -3]), rng.choice([None, "", "x\ny", "plain", "\n", "ü\n" * 50])) for i in range(140)]
    rows += [(5, "a", "en", 1, "tie"), (5, "a", "en", 1, "other"), (6, "b", "en", 2, "same\n"), (6, "b", "en", 2, "same\n"), (None, "a", None, None, None), (900, "alone", "en", 1, "one\n")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, root string").repartition(3)
    assert manifested(df) == plain_manifest(rows)
    assert manifested(df.limit(0)) == []
    one = df.filter("doc_id = 900")
    assert manifested(one) == plain_manifest([(900, "alone", "en", 1, "one\n")])


def test_manifest_proofs_and_kept_states(spark):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20)]
    tree = manifest.Subtree(leaves, manifest.height(20))
    assert [tree.fold(i, x.encode()).decode() for i, x in enumerate(leaves)] == [tree.root] * 20
    changed = manifest.Subtree([*leaves[:11], "0" * 64, *leaves[12:]], manifest.height(20))
    assert tree.fold(11, b"0" * 64).decode() == changed.root != tree.root
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = manifest.manifest(manifest.leaves(docs), with_proof=True).collect()
    assert all(r.verified and hashlib.sha256(r.proof.encode()).hexdigest() == r.proof_sha256 for r in got) and len(got) == docs.count()

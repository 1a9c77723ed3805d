"""Line rules, hard negatives and centroids against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrank.llm import centroids, hard_negatives, line_rules, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {p + j for at in windows.values() if len(at) > 1 for p in at for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def some_texts():
    r = random.Random(3)
    words = ["the", "and", "ou", "été", "x#", "|", "<b>", "Ω", "𝒳y", "end.", "zz", "a b"]
    texts = ["", " \n\t ", "\n\n", "a", "one two\x0bthree\x0cfour\r\nfive", "a " * 40, "ab cd " * 30, "x\nx\nx\n x", "w" * 5000, ("long text of words. " * 9 + "\n") * 400]
    for n in (5, 9, 20, 60, 200):
        texts += [r.choice(["", "\n"]).join(r.choice(words[:3 + n // 20]) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n)) for _ in range(12)]
    return texts


def test_base_counts_against_brute_force(spark, make_docs):
    texts = some_texts()
    docs = make_docs(texts).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("_rules", F.lit(1))
    got = line_rules.examine(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        c, want = r["_rules"]["counts"], base_counts(r["text"] or "")
        assert tuple(c[x] for x in line_rules.COUNTS) == want, (r["text"] or "")[:80]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["_rules"]["base_failed"] is failed and not (failed and r["_rules"]["kept"])


PROSE = "The cat sat on the mat and looked at the long road that led to the sea. "


@pytest.mark.parametrize("line, rule", [
    (PROSE, 0), ("Home | About | Contact | Help | Terms", 2), ("home | news from all of the regions | sports | our weather for today and more | help", 2), ("SHOP NOW FOR THE BEST PRICES", 2),
    ("Read more about this story here", 3), ("All Rights Reserved by the owners of this page.", 3), ("no end here", 1), ("Yes.", 0), ("This is *** a ### line %%% of &&& marks", 1),
    ("so so so so so so and on it goes", 3), ("", 0), ("   ", 0), ("这是一个没有空格的句子。", 0), ("a heading of several words", 0), (PROSE * 9 + "He asked her to sign in at the desk.", 0),
])
def test_line_rules(spark, line, rule):
    got = line_rules.examine(spark.createDataFrame([(1, line)], "doc_id long, text string")).first()["_rules"]["counts"]
    assert [got[f"n_{n}"] for n in line_rules.RULES] == [int(rule == i) for i in (1, 2, 3)]
    assert got["text"] == ("" if rule else line) and got["lost_chars"] == (got["word_chars"] if rule else 0)


def test_documents_are_cleaned_or_rejected(spark, make_docs):
    clean, menu = PROSE * 3, "Home | About | Contact | Help"
    docs = make_docs([f"{clean}\n{menu}\n\n{clean[:-1]}", f"{clean}\n" + f"{menu} {menu}\n" * 9, clean])
    out = line_rules.clean(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {}  # three copies of a sentence are repeats
    other = "A dog ran over a green field until it found some shade under an old tree by the wall. It slept there for most of the day."
    docs = make_docs([f"{other}\n{menu}\n\n{PROSE}", f"{other}\n" + f"{menu} {menu}\n" * 9, other])
    assert {r["doc_id"]: r["text"] for r in line_rules.clean(docs).collect()} == {0: f"{other}\n\n{PROSE}", 2: other}
    assert line_rules.clean(docs.limit(0)).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op11_line_rules(spark, sf).collect() if r["doc_id"] in good and not r["base_failed"]]
    kept = [r["kept"] for r in rows if good[r["doc_id"]] == 1]
    junk = [r["kept"] for r in rows if good[r["doc_id"]] == 0]
    assert sum(kept) >= 0.99 * len(kept) and sum(junk) <= 0.1 * len(junk)


VECTORS = "vec_id long, embedding array<double>, label long, score string, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y, "clash", "clash") for i, v, y in rows], VECTORS)


def odd_rows(d, scale=1.0):
    """Rows of nulls, non-finite and repeated vectors, another length, and equal vectors of several ids."""
    r = np.random.default_rng(1)
    v = (r.normal(size=(6, d)) * scale).tolist()
    return [(5001, None, 1), (5002, v[0][:-1] + [math.nan], 1), (5003, v[0][:-1] + [None], 1), (5004, v[0][:-1] + [math.inf], 1), (5005, [], 1),
            (5006, v[1][:-1], 2), (5050, v[2], None), (None, v[2], 1), (5051, v[3], 1), (5051, v[3], 1), (5100, v[4], 1), (5101, v[4], 2), (5102, v[4], 1), (5103, v[4], 3), (5150, [0.0] * d, 1)]


def mined(rows):
    """Brute force: every anchor against every row."""
    ok, seen = {}, set()
    for i, v, y in rows:
        if i is None or y is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        ok.setdefault(i, (np.array([math.floor(256 * c) for c in v], dtype=object), (y + 1) % 10 if i % 7 == 0 else y))
    out = set()
    for a in (i for i in ok if i % 50 == 0):
        x, label = ok[a]
        scored = sorted(((int((x * v).sum()), i, y) for i, (v, y) in ok.items() if i != a and len(v) == len(x)), key=lambda t: (-t[0], t[1]))
        for ps, p, _ in [t for t in scored if t[2] == label][:5]:
            fit = [(ns, n) for ns, n, y in scored if y != label and 50 * ps <= 100 * ns <= 95 * ps][:3]
            out |= {(a, p, rank, n, ps, ns) for rank, (ns, n) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("d, scale, cells", [(64, 0.1, False), (64, 0.1, True), (3, 1.0, True), (17, 3e5, False)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, d, scale, cells):
    if cells:
        for name, size in (("BLOCK", 3), ("GROUP", 100), ("LEAST", 40), ("_ANCHORS", 2), ("_ROWS", 33)):
            monkeypatch.setattr(hard_negatives, name, size)
    r = np.random.default_rng(d)
    centre = r.normal(size=(8, d)) * 2
    rows = [(i, ((centre[i % 8] + r.normal(size=d)) * scale).tolist(), int(r.integers(3)) if i % 3 else 1) for i in range(500)]
    rows += [(1000 + i, rows[i][1], 2) for i in range(40)] + odd_rows(d, scale)
    got = hard_negatives.mine(vectors(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == mined(rows) and len(found) > 30


def test_hard_negatives_edges(spark):
    one = [(0, [0.5, 0.5], 1)]
    for rows in ([], one, one + [(1, [0.4, 0.4], 1)], one + [(1, [0.4, 0.4], 2)]):
        assert hard_negatives.mine(vectors(spark, rows)).collect() == []
    # Scores beyond a long take no part; a repeated id has its smallest vector.
    rows = [(50, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.8, 0.8], 2), (2, [0.9, 0.9], 2), (3, [1e300, 1.0], 2)]
    assert [tuple(x) for x in hard_negatives.mine(vectors(spark, rows)).collect()] == [(50, 1, 1, 2, 2 * 256 * 256, 2 * 256 * 204)]


@pytest.mark.parametrize("d", [1, 2, 5, 16, 50, 64])
def test_bounds_lose_no_pair(d):
    r = np.random.default_rng(d)
    x, y = (np.floor(r.normal(size=(n, d)) * 100 + r.integers(-200, 200, size=(n, 1))).astype(np.int64) for n in (30, 200))
    a, b = (hard_negatives.Side(np.arange(len(v)), np.zeros(len(v), np.int64), v, *hard_negatives.summarise(v.astype(float), hard_negatives.FINE)) for v in (x, y))
    scores = x @ y.T
    for (ma, sa), (mb, sb) in zip(a.levels, b.levels):
        assert (np.abs(scores - ma @ mb.T) <= sa @ sb.T + 1e-6 * (1 + np.abs(scores).max())).all()
    low, high = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.97, axis=1)
    i, j, s = hard_negatives.wanted_pairs(a, b, low, high, np.ones(scores.shape, bool), np.float64)
    assert set(zip(i.tolist(), j.tolist(), s.tolist())) == {(p, q, int(scores[p, q])) for p in range(30) for q in range(200) if low[p] <= scores[p, q] <= high[p]}


def clustered(rows, k=40, rounds=5, d=64):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    x, c = np.array([v for _, v in ok], dtype=np.int64).reshape(-1, d), np.array([v for _, v in first], dtype=np.int64).reshape(-1, d)
    near = lambda: ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    for _ in range(rounds):
        own = near().argmin(1)
        c = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    dist = near()
    own, least = dist.argmin(1), dist.min(1)
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return collections.Counter((i, int(j), int(e), int(least[own == j].sum()), int(least.sum()), names[j]) for (i, _), j, e in zip(ok, own, least))


@pytest.mark.parametrize("n, d, k", [(400, 64, 40), (25, 64, 40), (300, 5, 7)])
def test_centroids_against_brute_force(spark, n, d, k):
    r = np.random.default_rng(n)
    rows = [(i, (r.normal(size=d) / 8).tolist(), 0) for i in range(n)]
    rows += [(900 + i, rows[i % n][1], 0) for i in range(30)] + odd_rows(d, 0.2)
    got = centroids.cluster(vectors(spark, rows), k=k, components=d)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(x) for x in got.collect()) == clustered(rows, k, 5, d)


def test_centroids_edges(spark):
    assert centroids.cluster(vectors(spark, [])).collect() == []
    assert centroids.cluster(vectors(spark, [(1, [1.0] * 63, 0), (2, [1e300] * 64, 0), (None, [0.5] * 64, 0)])).collect() == []
    same = centroids.cluster(vectors(spark, [(i, [0.5] * 64, 0) for i in range(90)])).collect()
    assert {(x["cluster"], x["distance"], x["inertia"]) for x in same} == {(0, 0, 0)} and len(same) == 90


@pytest.mark.parametrize("d, spread", [(1, 3), (2, 5), (64, 100)])
def test_search_finds_the_nearest_of_ties(d, spread):
    r = np.random.default_rng(d)
    x, c = r.integers(-spread, spread, size=(500, d)), r.integers(-spread, spread, size=(23, d))
    who, best = centroids.Search(c).nearest(x)
    dist = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert np.array_equal(who, dist.argmin(1)) and np.array_equal(best, dist.min(1))

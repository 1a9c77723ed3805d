"""Metrics against brute force, golden values and edge groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqrank.functions import ordering
from seqrank.functions.ordering import with_position, with_row_index
from seqrank.operators import clean as C
from seqrank.operators import metrics as M


def _rank(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def _corr(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    sa, sb = sum((x - ma) ** 2 for x in a), sum((x - mb) ** 2 for x in b)
    return None if sa == 0 or sb == 0 else sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sa * sb)


def _percentile(xs, q):
    s = sorted(xs)
    at = q * (len(s) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return s[lo] + (s[hi] - s[lo]) * (at - lo)


def _brute(ys, ps):
    n = len(ys)
    ry, rp = _rank(ys), _rank(ps)
    by = [y >= _percentile(ys, 0.9) for y in ys]
    bp = [p >= _percentile(ps, 0.9) for p in ps]
    pos, neg = sum(by), n - sum(by)
    auc = None
    if neg:
        auc = sum((ps[i] > ps[j]) + (ps[i] == ps[j]) / 2 for i in range(n) for j in range(n) if by[i] and not by[j]) / (pos * neg)
    tp = sum(a and b for a, b in zip(by, bp))
    scale = pos * neg * sum(bp) * (n - sum(bp))
    mcc = (tp * n - pos * sum(bp)) / math.sqrt(scale) if scale else 0.0
    k = max(1, n // 10)
    disc = [1 / math.log2(i + 2) if i < k else 0.0 for i in range(n)]
    order = sorted(set(ps), reverse=True)
    dcg, at = 0.0, 0
    for p in order:
        idx = [i for i in range(n) if ps[i] == p]
        dcg += sum(ry[i] for i in idx) / len(idx) * sum(disc[at:at + len(idx)])
        at += len(idx)
    ideal = sum(d * r for d, r in zip(disc, sorted(ry, reverse=True)))
    ap, found, seen = 0.0, 0, 0
    for p in order:
        idx = [i for i in range(n) if ps[i] == p]
        new = sum(by[i] for i in idx)
        seen, found = seen + len(idx), found + new
        ap += new / pos * found / seen
    return {"n": n, "spearman": _corr(ry, rp), "auc": auc, "mcc": mcc, "ndcg": dcg / ideal, "ap": ap}


def _groups():
    rng = random.Random(5)
    out = {}
    for g in range(25):
        n = rng.choice([1, 2, 5, 9, 10, 11, 31, 120])
        top = rng.choice([2, 5, 1000])
        out[f"g{g}"] = [(rng.randint(0, top) / 4.0 - 1, rng.randint(0, top) / 8.0 - 3) for _ in range(n)]
    out["flat"] = [(float(i), 1.0) for i in range(12)]
    out["flat_label"] = [(1.0, float(i)) for i in range(12)]
    return out


def test_ranking_metrics_equal_brute_force(spark):
    groups = _groups()
    rows = [(g, y, p) for g, xs in groups.items() for y, p in xs]
    got = {r["g"]: r for r in M.ranking_metrics(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        want = _brute([y for y, _ in xs], [p for _, p in xs])
        for name, value in want.items():
            assert got[g][name] == pytest.approx(value, abs=1e-9), (g, name)


def test_constant_prediction(spark):
    rows = [("a", float(i), 7.0) for i in range(20)]
    r = M.ranking_metrics(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p").first()
    assert (r["spearman"], r["auc"], r["mcc"]) == (None, 0.5, 0.0)


def test_null_group_is_kept(spark):
    rows = [(None, 1.0, 2.0), (None, 2.0, 3.0), ("a", 1.0, 1.0)]
    got = M.spearman(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p").collect()
    assert {r["g"]: r["spearman"] for r in got} == {None: pytest.approx(1.0), "a": None}


def test_golden_five_rows(spark):
    rows = [(0.1, 0.12), (0.3, 0.28), (0.7, 0.7), (0.9, 0.89), (0.55, 0.54)]
    df = spark.createDataFrame(rows, "DMS_score double, mock_score double").withColumn("k", F.lit(1))
    assert C.infer_score_column(df.columns) == "mock_score"
    assert M.evaluate(df, ["k"], "DMS_score", "mock_score").first()["spearman"] == pytest.approx(1.0)


def test_kendall_equals_all_pairs(spark):
    groups = _groups()
    rows = [(g, y, p) for g, xs in groups.items() for y, p in xs]
    got = {r["g"]: r["kendall_tau"] for r in M.kendall_tau(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p").collect()}
    for g, xs in groups.items():
        s = tx = ty = 0
        for i in range(len(xs)):
            for j in range(i):
                a, b = xs[i][0] - xs[j][0], xs[i][1] - xs[j][1]
                s += (a > 0) - (a < 0) if b > 0 else (a < 0) - (a > 0) if b < 0 else 0
                tx += a != 0
                ty += b != 0
        want = s / math.sqrt(tx * ty) if tx and ty else None
        assert got[g] == (None if want is None else pytest.approx(want, abs=1e-12)), g


def test_hits_with_nine_rows(spark):
    rows = [("a", i, float(i), float(i)) for i in range(9)]
    r = M.top_bottom_hits(spark.createDataFrame(rows, "g string, i long, y double, p double"), ["g"], "y", "p", "i").first()
    assert r["top_hit_10"] == 0.0
    assert r["bottom_hit_10"] is None and r["unbias_hit_10"] is None


def test_discount_sum_of_long_runs(spark):
    cases = [(1, 10), (1, 4096), (1, 9000), (63, 70000), (64, 5000), (3, 2), (90000, 300000)]
    df = spark.createDataFrame(cases, "a long, b long")
    for r in df.select("a", "b", M.discount_sum("a", "b").alias("d")).collect():
        want = math.fsum(1 / math.log2(i + 1) for i in range(r["a"], r["b"] + 1))
        assert r["d"] == pytest.approx(want, abs=1e-8)


def test_r2_and_concordance_edges(spark):
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 1.0), ("off", 1.0, 2.0), ("off", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, t double, p double")
    r2 = {r["g"]: r["r2"] for r in M.regression_errors(df, ["g"], "t", "p").collect()}
    assert r2 == {"one": None, "flat": 1.0, "off": 0.0}
    assert all(r["ccc"] is None for r in M.concordance(df, ["g"], "t", "p").collect())


@pytest.fixture(params=["plain", "leveled"])
def way(request, monkeypatch):
    """Both ways of ordering: with and without groups above the window limit."""
    if request.param == "leveled":
        monkeypatch.setattr(ordering, "WINDOW_ROWS", 8)
    return request.param


def test_positions_with_a_hot_group_and_hot_value(spark, way):
    df = spark.range(30000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 AS string)) AS g", "if(id % 2 = 0, 1D, id / 7D) AS v", "md5(cast(id AS string)) AS h")
    for order in (["v", "id"], ["h"], ["v", "h", "id"]):
        bad = with_position(df, ["g"], order, "pos", total="n").withColumn(
            "want", F.expr(f"row_number() OVER (PARTITION BY g ORDER BY {', '.join(order)}) - 1")).withColumn(
            "all", F.expr("count(*) OVER (PARTITION BY g)")).filter("pos <> want OR n <> all").count()
        assert bad == 0


def test_row_index_is_dense(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id AS v")
    got = sorted(r["row_idx"] for r in with_row_index(df).collect())
    assert got == list(range(1000))
    assert all(r["row_idx"] == r["v"] for r in with_row_index(df, ["v"]).collect())


@pytest.mark.parametrize("kind", ["aggregate", "join", "distinct", "union"])
def test_row_index_is_dense_behind_a_shuffle(spark, kind):
    """Wide rows whose shuffle is cut differently for a plan that reads fewer columns."""
    wide = spark.range(300_000).selectExpr("id % 299999 AS k", "id", "repeat(md5(cast(id AS string)), 8) AS text")
    df = {
        "aggregate": lambda: wide.groupBy("k").agg(F.max("text").alias("text"), F.min("id").alias("id")),
        "join": lambda: wide.join(spark.range(150_000).selectExpr("id AS k", "id AS other"), "k", "left"),
        "distinct": lambda: wide.select("k", "text").distinct(),
        "union": lambda: wide.unionByName(wide.groupBy("k").agg(F.max("id").alias("id"), F.max("text").alias("text"))),
    }[kind]()
    n = {"aggregate": 299_999, "union": 599_999}.get(kind, 300_000)
    out = with_row_index(df)
    assert out.columns == [*df.columns, "row_idx"]
    assert out.agg(F.count("text"), F.min("row_idx"), F.max("row_idx"), F.countDistinct("row_idx")).first()[:] == (n, 0, n - 1, n)


def test_status_of_files(spark):
    rows = [("a", 1.0, 1.0, None), ("a", 2.0, 3.0, None), ("b", 1.0, None, 2.0), ("c", 1.0, None, None), ("d", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "file string, DMS_score double, wt_score double, masked_score double")
    got = {r["file"]: r["status"] for r in M.per_file_correlation(df, "file").collect()}
    assert got == {"a": "computed", "b": "zero variance", "c": "missing", "d": "missing"}


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_kendall_over_several_grids(spark, block):
    """Blocks of a few places force a grid of grids; ties on both sides, a group of one, a constant and a null group."""
    rng = random.Random(8)
    rows = [(g, rng.choice([rng.random(), rng.randint(0, 6) / 4]), rng.choice([rng.random(), rng.randint(0, 3)])) for g in ("a", "b", None) for _ in range(90)]
    rows += [("one", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame([(g, float(t), float(p)) for g, t, p in rows], "g string, t double, p double")
    got = {r["g"]: r["kendall_tau"] for r in M.kendall_tau(df, ["g"], "t", "p", block=block, window_rows=0 if block == 5 else None).collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for g in ("a", "b", None, "one", "flat"):
        pts = [(t, p) for k, t, p in rows if k == g]
        ab = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(pts) for b in pts[:i]]
        scale = math.sqrt(sum(x != 0 for x, _ in ab)) * math.sqrt(sum(y != 0 for _, y in ab))
        assert got[g] == (pytest.approx(sum(x * y for x, y in ab) / scale, abs=1e-12) if scale else None)


def test_strips_count_inversions():
    import numpy as np

    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (50, 6), (300, 1000)):
        i, j, w = r.integers(0, top, n), r.integers(0, top, n), r.integers(1, 4, n)
        want = sum(int(w[a] * w[b]) for a in range(n) for b in range(n) if i[a] < i[b] and j[a] > j[b])
        assert M.strip_inversions(i, j, w, step=7) == M.strip_inversions(i, j, w) == want


def test_hits_of_large_groups_take_the_levels(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randint(0, 9)), float(rng.randint(0, 4)), i) for g in ("a", "b") for i in range(237 if g == "a" else 9)]
    df = spark.createDataFrame(rows, "g string, y double, p double, id long")
    small, large = (M.top_bottom_hits(df, ["g"], "y", "p", "id", window_rows=w).orderBy("g").collect() for w in (None, 0))
    assert small == large

"""Greedy plans against the item-by-item loops, and split invariants."""

import random

import pytest
from pyspark.sql import functions as F

from seqrank.operators import splits as S


def _unfold(phases, count):
    out = []
    for t in range(count):
        start, bins = [p for p in phases if p[0] <= t][-1]
        out.append(bins[(t - start) % len(bins)])
    return out


def _hist(rng):
    return {rng.randint(1, 30): rng.randint(1, 12) for _ in range(rng.randint(1, 8))}


@pytest.mark.parametrize("count_ties", [False, True])
def test_dealing_equals_item_loop(count_ties):
    rng = random.Random(1)
    for _ in range(400):
        hist, k = _hist(rng), rng.randint(1, 6)
        phases, got, loads = S.plan_balanced(hist, k, count_ties)
        sums, held = [0] * k, [0] * k
        for s in sorted(hist, reverse=True):
            want = []
            for _ in range(hist[s]):
                j = min(range(k), key=lambda b: (sums[b], held[b] if count_ties else 0, b))
                sums[j] += s
                held[j] += 1
                want.append(j)
            assert _unfold(phases[s], hist[s]) == want
            assert got[s] == [want.count(j) for j in range(k)]
        assert loads == sums


def test_valid_choice_equals_item_loop():
    rng = random.Random(2)
    for _ in range(400):
        pool = _hist(rng)
        items = [s for s in sorted(pool, reverse=True) for _ in range(pool[s])]
        target = rng.randint(0, sum(items))
        chosen, total, left = set(), 0, []
        for i, s in enumerate(items):
            if total + s <= target:
                chosen.add(i)
                total += s
            else:
                left.append(i)
        if total < target and left:
            chosen.add(min(left, key=lambda i: abs(total + items[i] - target)))
        if not chosen:
            chosen.add(0)
        if len(chosen) == len(items) and len(items) > 1:
            chosen.remove(len(items) - 1)
        take = S.plan_valid(pool, target)
        # Within one size the first clusters are taken.
        flat = set()
        for s in pool:
            first = items.index(s)
            flat |= set(range(first, first + take[s]))
        assert sorted(items[i] for i in flat) == sorted(items[i] for i in chosen)
        assert len(flat) == len(chosen)


def test_deficit_choice_equals_item_loop():
    rng = random.Random(3)
    for _ in range(300):
        hist = _hist(rng)
        total = sum(s * n for s, n in hist.items())
        test, valid = int(total * 0.2), int(total * 0.1)
        targets = (total - test - valid, valid, test)
        plan, n = S.plan_deficit(hist, targets), [0, 0, 0]
        for s in sorted(hist, reverse=True):
            want = []
            for _ in range(hist[s]):
                gap = [t - x for t, x in zip(targets, n)]
                j = max(range(3), key=lambda b: (gap[b], -b)) if max(gap) > 0 else min(range(3), key=lambda b: (n[b], b))
                n[j] += s
                want.append(j)
            assert _unfold(plan[s], hist[s]) == want


def _table(spark, n=3000):
    return spark.range(n).selectExpr("id AS row_idx", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 29 = 0 THEN NULL ELSE concat('c', id % 113) END AS cluster")


def _check_cover(spark, df, out, k):
    per = out.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("d")).collect()
    assert len(per) == k and all(r["n"] == r["d"] == df.count() for r in per)


@pytest.mark.parametrize("name", ["greedy", "group", "default"])
def test_cluster_splits_do_not_leak(spark, name):
    df = _table(spark)
    out = {
        "greedy": lambda: S.greedy_balanced_kfold(df, "cluster", 4),
        "group": lambda: S.group_kfold(df, "cluster", 4, 0.1),
        "default": lambda: S.default_cv(df, 4, "cluster"),
    }[name]()
    _check_cover(spark, df, out, 4)
    named = df.withColumn("cluster", F.coalesce("cluster", F.lit("none")))
    overlap = S.check_leakage(out, named, ["cluster"]).collect()
    assert all(r["train_valid"] == r["train_test"] == r["valid_test"] == 0 for r in overlap)
    assert out.filter("split = 'valid'").select("fold").distinct().count() == 4


def test_group_default_cv_equals_item_loop(spark):
    """Outer folds and the inner validation fold, one cluster at a time."""
    import hashlib

    df = _table(spark, 600)
    sizes = {}
    for r in df.collect():
        sizes.setdefault(r["cluster"] or S.MISSING_CLUSTER, []).append(r["row_idx"])

    def deal(clusters, k, seed):
        order = sorted(clusters, key=lambda c: (-len(sizes[c]), hashlib.md5(f"{seed}|{c}".encode()).hexdigest()))
        load, held, home = [0] * k, [0] * k, {}
        for c in order:
            j = min(range(k), key=lambda b: (load[b], held[b], b))
            load[j] += len(sizes[c])
            held[j] += 1
            home[c] = j
        return home, load

    outer, _ = deal(sizes, 3, 5)
    want = set()
    for f in range(3):
        pool = [c for c in sizes if outer[c] != f]
        inner, load = deal(pool, min(9, len(pool)), 5 + f + 1)
        target = max(1, round(sum(len(sizes[c]) for c in pool) * 0.1))
        pick = min(range(len(load)), key=lambda j: (abs(load[j] - target), load[j], j))
        for c, rows in sizes.items():
            split = "test" if outer[c] == f else "valid" if inner[c] == pick else "train"
            want |= {(f, split, r) for r in rows}
    got = {(r["fold"], r["split"], r["row_idx"]) for r in S.default_cv(df, 3, "cluster", 5).collect()}
    assert got == want


def test_too_few_groups(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a")], "row_idx long, cluster string")
    with pytest.raises(ValueError):
        S.balanced_group_folds(df, "cluster", 2)
    with pytest.raises(ValueError):
        S.group_train_valid(df, "cluster", 0.1)
    assert S.default_cv(df, 2, "cluster").count() == 4


def test_missing_cluster_policies(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "a")], "row_idx long, cluster string")
    got = {p: [r["cluster"] for r in S.with_cluster(df, "cluster", missing=p).orderBy("row_idx").collect()] for p in ("group", "row", "unknown")}
    assert got["group"] == [S.MISSING_CLUSTER, "", "a"]
    assert got["row"] == ["cluster_0000", "cluster_0001", "a"]
    assert got["unknown"] == ["unknown", "", "a"]
    with pytest.raises(Exception, match="not allowed"):
        S.with_cluster(df, "cluster", missing="error").collect()


def test_sample_errors(spark):
    df = spark.range(10).selectExpr("id", "'s' AS s")
    with pytest.raises(Exception, match="smaller than the data"):
        S.stratified_sample(df, "s", 10, "id").collect()
    assert S.stratified_sample(df, "s", 4, "id").count() == 4


def test_split_size_mismatch_fails(spark):
    df = _table(spark, 50)
    splits = S.train_valid_random(df, 0.2).withColumn("fold", F.lit(0))
    meta = spark.createDataFrame([(49, None)], "size long, fingerprint string")
    checks = S.validate_splits(df, splits, meta, ["cluster"])
    assert not checks.first()["size_ok"]
    with pytest.raises(Exception, match="does not fit"):
        S.require_valid(checks).collect()


def test_holdout_sizes(spark):
    one = spark.createDataFrame([(0,)], "row_idx long")
    assert {r["split"] for r in S.train_valid_random(one, 0.5).collect()} == {"train"}
    ten = spark.range(10).selectExpr("id AS row_idx")
    assert S.train_valid_random(ten, 0.0).filter("split = 'valid'").count() == 0
    assert S.train_valid_random(ten, 0.01).filter("split = 'valid'").count() == 1


def test_qcut_constant_column(spark):
    df = spark.range(40).selectExpr("id", "3D AS v")
    assert {r["bin"] for r in S.qcut_bins(df, "v").collect()} == {0}


def _above_rows(df, leaf="Range ("):
    """The operators above each leaf that reads the rows, from the plan text."""
    found, path = [], []
    for line in df._jdf.queryExecution().sparkPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        path = [(d, t) for d, t in path if d < depth] + [(depth, line.strip(" :+-"))]
        if leaf in line:
            found.append([t for _, t in path[:-1]])
    return found


@pytest.mark.parametrize("n", [1, 4, 7, 3000])
def test_hash_order_splits_equal_plain_loop(spark, n):
    """Positions in hash order row by row; repeated and null row numbers, fewer rows than folds."""
    import hashlib
    from collections import Counter

    ids = [i // 2 if i % 3 else i for i in range(n - 1)] + [None]
    df = spark.createDataFrame([(i,) for i in ids], "row_idx long").repartition(3)

    def order(rows, seed):
        return sorted(rows, key=lambda i: hashlib.md5(f"{seed}|{i}".encode() if i is not None else f"{seed}".encode()).hexdigest())

    placed = order(ids, 9)
    base, extra = divmod(n, 4)
    home = [j for j in range(4) for _ in range(base + (j < extra))]
    want = Counter()
    for f in range(4):
        rest = order([i for i, h in zip(placed, home, strict=True) if h != f], f"inner{f}")
        want.update((f, "train" if p < int(len(rest) * 0.8) else "valid", i) for p, i in enumerate(rest))
        want.update((f, "test", i) for i, h in zip(placed, home, strict=True) if h == f)
    got = S.random_kfold(df, 4, 0.8, 9).collect()
    assert Counter(tuple(r) for r in got) == want


def test_hash_order_splits_move_no_rows(spark):
    """Rows learn their split where they are: nothing above the scan of the table exchanges or sorts them."""
    df = spark.range(5000).selectExpr("id AS row_idx")
    for out in (S.sliced_random_folds(df, 5), S.repeated_random_folds(df, 5, 0.1, 0.2), S.random_kfold(df, 4), S.random_kfold(df, 1), S.train_valid_random(df, 0.2)):
        above = _above_rows(out)
        assert above and not [t for path in above for t in path if t.startswith(("Window", "Sort", "Exchange"))]

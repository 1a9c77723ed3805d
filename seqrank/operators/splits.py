"""Leakage-safe splits, sampling and split checks.

A split is a long table ``(fold, split, row_idx)``. Greedy balancing looks at
cluster *sizes* only, so it runs on the size histogram: N rows have at most
sqrt(2N) distinct cluster sizes. That histogram is the only thing that reaches
the driver. Clusters of one size are dealt by their rank in hash order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import attach_row, group_key, hash_key, with_position
from ..session import checkpoint_dir

# Fixed value: stands for rows without a cluster.
MISSING_CLUSTER = "__missing_cluster__"
_PLAN_SCHEMA = "fold int, size long, phases array<struct<start:long,bins:array<int>>>"

Phases = list[tuple[int, list[int]]]


# ------------------------------------------------------------------ greedy plans on histograms

def deal_equal(loads: list[int], size: int, count: int, held: list[int] | None = None) -> tuple[Phases, list[int]]:
    """Deal ``count`` items of one size, each to the lightest bin.

    Ties go to the bin with fewer items when ``held`` is given, then to the
    lower bin number. Bins join the round-robin as the level rises, so at most
    one phase per bin is needed: item ``t`` of a phase goes to
    ``bins[(t - start) % len(bins)]``. Returns the phases and the items per
    bin; ``loads`` and ``held`` are updated.
    """
    lowest = min(loads)
    joins = [(x - lowest) // size for x in loads]
    rests = [(x - lowest) % size for x in loads]
    rank = [(rests[j], held[j] - joins[j] if held else 0, j) for j in range(len(loads))]
    phases, got, dealt = [], [0] * len(loads), 0
    steps = sorted(set(joins))
    for i, step in enumerate(steps):
        if dealt == count:
            break
        bins = sorted((j for j in range(len(loads)) if joins[j] <= step), key=rank.__getitem__)
        room = (steps[i + 1] - step) * len(bins) if i + 1 < len(steps) else count - dealt
        take = min(room, count - dealt)
        phases.append((dealt, bins))
        for b, j in enumerate(bins):
            got[j] += take // len(bins) + (1 if b < take % len(bins) else 0)
        dealt += take
    for j, n in enumerate(got):
        loads[j] += n * size
        if held is not None:
            held[j] += n
    return phases, got


def plan_balanced(hist: dict[int, int], bins: int, count_ties: bool = False) -> tuple[dict[int, Phases], dict[int, list[int]], list[int]]:
    """Phases and clusters per bin for every size, largest first, and the final loads."""
    loads, held = [0] * bins, [0] * bins if count_ties else None
    phases, got = {}, {}
    for size in sorted(hist, reverse=True):
        phases[size], got[size] = deal_equal(loads, size, hist[size], held)
    return phases, got, loads


def plan_valid(pool: dict[int, int], target: int) -> dict[int, int]:
    """Clusters of each size to take for validation.

    First fit, largest first, never above the target; if short, the one
    cluster with the least absolute error; never nothing, never everything.
    """
    order = [s for s in sorted(pool, reverse=True) if pool[s] > 0]
    take, total = dict.fromkeys(order, 0), 0
    for s in order:
        take[s] = min(pool[s], max(0, target - total) // s)
        total += take[s] * s
    left = [s for s in order if take[s] < pool[s]]
    if total < target and left:
        take[min(left, key=lambda s: abs(total + s - target))] += 1
    if order and not any(take.values()):
        take[order[0]] = 1
    if sum(pool[s] for s in order) > 1 and all(take[s] == pool[s] for s in order):
        take[order[-1]] -= 1
    return take


def plan_valid_overshoot(pool: dict[int, int], target: int) -> dict[int, int]:
    """Largest groups first until the target is reached, possibly beyond it."""
    order = [s for s in sorted(pool, reverse=True) if pool[s] > 0]
    take, total = dict.fromkeys(order, 0), 0
    for s in order:
        take[s] = min(pool[s], max(0, -((total - target) // s)) if total < target else 0)
        total += take[s] * s
    if order and not any(take.values()):
        take[order[0]] = 1
    if order and all(take[s] == pool[s] for s in order):
        take[order[-1]] -= 1
    return take


def plan_deficit(hist: dict[int, int], targets: Sequence[int]) -> dict[int, Phases]:
    """Each cluster to the split with the largest remaining deficit, else to the smallest split."""
    placed, plan = [0] * len(targets), {}
    for size in sorted(hist, reverse=True):
        count = hist[size]
        over = [n - t for n, t in zip(placed, targets, strict=True)]
        wanted = min(count, sum(ceil(-x / size) for x in over if x < 0))
        phases: Phases = []
        if wanted:
            phases, got = deal_equal(over, size, wanted)
            placed = [n + g * size for n, g in zip(placed, got, strict=True)]
        if count > wanted:
            more, _ = deal_equal(placed, size, count - wanted)
            phases = phases + [(wanted + start, bins) for start, bins in more]
        plan[size] = phases
    return plan


def _taking(take: int) -> Phases:
    """Phases that send the first ``take`` ranks to bin 1 and the rest to bin 0."""
    return ([(0, [1])] if take else []) + [(take, [0])]


def _histogram(clusters: DataFrame) -> dict[int, int]:
    """Cluster sizes and their counts; at most sqrt(2N) rows."""
    return {r["size"]: r["n"] for r in clusters.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}


def _bin_of(rank: str = "rank") -> Column:
    return F.expr(
        f"transform(array(element_at(filter(phases, x -> x.start <= {rank}), -1)), "
        f"p -> element_at(p.bins, cast(({rank} - p.start) % size(p.bins) AS int) + 1))[0]"
    )


def _dealt(clusters: DataFrame, plan: dict[int, dict[int, Phases]], seeds: dict[int, int], out: str) -> DataFrame:
    """Rank clusters per (fold, size) in hash order and look up their bin.

    ``clusters`` has ``fold, cluster, size``; the plan has one row per fold and
    distinct size, so Spark may broadcast it when it is small.
    """
    spark = clusters.sparkSession
    rows = [(f, s, [(a, b) for a, b in ph]) for f, sizes in plan.items() for s, ph in sizes.items()]
    table = spark.createDataFrame(rows, _PLAN_SCHEMA)
    seed = F.coalesce(*[F.when(F.col("fold") == f, F.lit(s)) for f, s in seeds.items()])
    keyed = clusters.withColumn("_h", hash_key(seed, F.col("cluster")))
    ranked = with_position(keyed, ["fold", "size"], ["_h"], "rank", digests=["_h"]).drop("_h")
    return ranked.join(table, ["fold", "size"]).withColumn(out, _bin_of()).drop("phases", "rank")


# ------------------------------------------------------------------ clusters and rows

def with_cluster(df: DataFrame, cluster: str, row_idx: str = "row_idx", missing: str = "group") -> DataFrame:
    """``(row_idx, cluster)`` with missing clusters handled.

    ``group``: one shared group; ``row``: one group per row (null or empty);
    ``unknown``: nulls share ``unknown``; ``error``: null or empty is an error.
    """
    c = F.col(cluster).cast("string")
    empty = c.isNull() | (c == "")
    value = {
        "group": F.coalesce(c, F.lit(MISSING_CLUSTER)),
        "unknown": F.coalesce(c, F.lit("unknown")),
        "row": F.when(empty, F.format_string("cluster_%04d", F.col(row_idx))).otherwise(c),
        "error": F.when(empty, F.raise_error(F.lit("empty clusters are not allowed")).cast("string")).otherwise(c),
    }[missing]
    return df.select(F.col(row_idx).cast("long").alias("row_idx"), F.coalesce(value, F.lit("")).alias("cluster"))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def _attach(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with their (fold, split); one row per cluster crosses the join, not one per fold."""
    packed = decisions.groupBy("cluster").agg(F.collect_list(F.struct("fold", "split")).alias("_d"))
    return rows.join(packed, "cluster").select(F.inline("_d"), "row_idx")


def _pools(got: dict[int, list[int]], fold: int) -> dict[int, int]:
    return {s: sum(n) - n[fold] for s, n in got.items()}


def _cluster_kfold(clusters: DataFrame, hist: dict[int, int], k: int, seed: int, count_ties: bool = False):
    phases, got, loads = plan_balanced(hist, k, count_ties)
    tested = _dealt(clusters.withColumn("fold", F.lit(0)), {0: phases}, {0: seed}, "test_fold").drop("fold")
    return tested, got, loads


def _with_inner(tested: DataFrame, k: int, plan: dict[int, dict[int, Phases]], seeds: dict[int, int]) -> DataFrame:
    """Test, valid and train decisions per fold; bin 1 of the inner plan is validation."""
    every = tested.select("cluster", "size", "test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    pool = every.filter("fold <> test_fold").select("fold", "cluster", "size")
    inner = _dealt(pool, plan, seeds, "_bin").select("cluster", "fold", F.when(F.col("_bin") == 1, "valid").otherwise("train").alias("split"))
    return inner.unionByName(tested.select("cluster", F.col("test_fold").alias("fold"), F.lit("test").alias("split")))


def greedy_balanced_kfold(
    df: DataFrame, cluster: str, k: int, valid_frac: float = 0.1, seed: int = 42, row_idx: str = "row_idx", missing: str = "group"
) -> DataFrame:
    """Whole clusters to folds, largest first to the lightest; valid from the rest."""
    rows = with_cluster(df, cluster, row_idx, missing)
    clusters = _sizes(rows)
    tested, got, _ = _cluster_kfold(clusters, _histogram(clusters), k, seed)
    plan = {}
    for f in range(k):
        pool = _pools(got, f)
        target = round(sum(s * n for s, n in pool.items()) * valid_frac)
        plan[f] = {s: _taking(n) for s, n in plan_valid(pool, target).items()}
    return _attach(rows, _with_inner(tested, k, plan, {f: seed + 1000 + f for f in range(k)}))


def kfold_random_valid(df: DataFrame, cluster: str, k: int, valid_frac: float = 0.1, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Balanced test folds; valid = the first share of the shuffled training clusters (G3). Rows without a cluster belong to no fold."""
    rows = with_cluster(df.filter(F.col(cluster).isNotNull()), cluster, row_idx)
    clusters = _sizes(rows)
    tested, _, _ = _cluster_kfold(clusters, _histogram(clusters), k, seed)
    every = tested.select("cluster", "test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    pool = every.filter("fold <> test_fold").select("fold", "cluster", hash_key(F.col("fold") + F.lit(seed), F.col("cluster")).alias("_h"))
    placed = with_position(pool, ["fold"], ["_h"], "_i", total="_n")
    split = F.when(F.col("_i") < F.floor(F.col("_n") * F.lit(valid_frac)), "valid").otherwise("train")
    decisions = placed.select("cluster", "fold", split.alias("split")).unionByName(
        tested.select("cluster", F.col("test_fold").alias("fold"), F.lit("test").alias("split")))
    return _attach(rows, decisions)


def single_split_deficit(df: DataFrame, cluster: str, test_frac: float, valid_frac: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """One split by largest remaining deficit (G4). Rows without a cluster belong to no split."""
    rows = with_cluster(df.filter(F.col(cluster).isNotNull()), cluster, row_idx)
    clusters = _sizes(rows)
    total = df.count()
    test, valid = int(total * test_frac), int(total * valid_frac)
    plan = plan_deficit(_histogram(clusters), (total - test - valid, valid, test))
    placed = _dealt(clusters.withColumn("fold", F.lit(0)), {0: plan}, {0: seed}, "_bin")
    names = F.array(F.lit("train"), F.lit("valid"), F.lit("test"))
    return _attach(rows, placed.select("cluster", "fold", F.element_at(names, F.col("_bin") + 1).alias("split")))


def group_kfold(df: DataFrame, group: str, k: int, target_valid: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Group folds; valid groups are added largest first until the target share of all rows."""
    rows = with_cluster(df, group, row_idx, "unknown")
    clusters = _sizes(rows)
    hist = _histogram(clusters)
    if sum(hist.values()) < k:
        raise ValueError(f"{sum(hist.values())} groups are fewer than {k} folds")
    tested, got, _ = _cluster_kfold(clusters, hist, k, seed)
    target = max(1, round(target_valid * sum(s * n for s, n in hist.items())))
    plan = {f: {s: _taking(n) for s, n in plan_valid_overshoot(_pools(got, f), target).items()} for f in range(k)}
    return _attach(rows, _with_inner(tested, k, plan, {f: seed + f for f in range(k)}))


def balanced_group_folds(df: DataFrame, group: str, n: int, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Groups, largest first, to the fold with fewest rows, then fewest groups (G10): ``(fold, row_idx)``."""
    rows = with_cluster(df, group, row_idx)
    clusters = _sizes(rows)
    hist = _histogram(clusters)
    if sum(hist.values()) < n:
        raise ValueError(f"cannot build {n} folds from {sum(hist.values())} groups")
    tested, _, _ = _cluster_kfold(clusters, hist, n, seed, count_ties=True)
    return rows.join(tested.select("cluster", F.col("test_fold").alias("fold")), "cluster").select("fold", "row_idx")


def _closest_fold(hist: dict[int, int], frac: float) -> dict[int, Phases]:
    """Inner plan whose bin 1 is the group fold closest to the target size, the smaller one on ties."""
    groups = sum(hist.values())
    if groups < 2:
        raise ValueError("a group-aware validation split needs two groups")
    phases, _, loads = plan_balanced({s: n for s, n in hist.items() if n}, min(9, groups), count_ties=True)
    target = max(1, round(sum(s * n for s, n in hist.items()) * frac))
    chosen = min(range(len(loads)), key=lambda j: (abs(loads[j] - target), loads[j], j))
    return {s: [(a, [int(j == chosen) for j in bins]) for a, bins in ph] for s, ph in phases.items()}


def group_train_valid(df: DataFrame, group: str, frac: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """One train/valid split on whole groups."""
    rows = with_cluster(df, group, row_idx)
    clusters = _sizes(rows)
    placed = _dealt(clusters.withColumn("fold", F.lit(0)), {0: _closest_fold(_histogram(clusters), frac)}, {0: seed}, "_bin")
    return _attach(rows, placed.select("cluster", "fold", F.when(F.col("_bin") == 1, "valid").otherwise("train").alias("split")))


# ------------------------------------------------------------------ hash-order splits

def _parted(rows: DataFrame, groups: Sequence[str], seed: int | Column, key: str, bounds: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """Add ``_part``, the number of ``bounds`` at or below the position of a row in hash order, and ``_n``, the rows of its group.

    ``bounds`` gives ascending positions from the group size. A group is counted by
    the first 16 bits of its hashes; a bound falls into one such cell, and rows
    elsewhere know their part without a shuffle. Only the rows of those cells are
    ranked. One row per group reaches the driver.
    """
    spark = rows.sparkSession
    names = list(groups) or ["_all"]
    keyed = rows if groups else rows.withColumn("_all", F.lit(0))
    keyed = keyed.withColumn("_h", hash_key(seed, F.col(key))).withColumn("_cell", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    w = Window.partitionBy(*names)
    cells = keyed.groupBy(*names, "_cell").agg(F.count(F.lit(1)).alias("_rows")).select(
        *names, "_cell", (F.sum("_rows").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(w).alias("_n"), "_rows")
    # The last cell that starts at or before a bound; none if the bound is below 0, past the last if it is no position.
    starts = [F.max(F.when(F.col("_before") <= F.col("_b")[j], F.struct("_cell", "_before"))).alias(f"_s{j}") for j in range(len(bounds(F.col("_n"))))]
    cuts = cells.withColumn("_b", F.array(*[b.cast("long") for b in bounds(F.col("_n"))])).groupBy(*names).agg(F.max("_n").alias("_n"), F.max("_b").alias("_b"), *starts)
    cut = F.array(*[F.struct(
        F.when(F.col("_b")[j] >= F.col("_n"), F.lit(1 << 16)).otherwise(F.coalesce(F.col(f"_s{j}._cell"), F.lit(-1))).alias("cell"),
        F.coalesce(F.col(f"_s{j}._before"), F.lit(0)).alias("before"), F.col("_b")[j].alias("bound")) for j in range(len(starts))])
    table = cuts.select(*names, "_n", cut.alias("_cuts"))
    table = F.broadcast(spark.createDataFrame(table.collect(), table.schema))
    marked = keyed.join(table, names)
    apart = marked.filter("NOT exists(_cuts, c -> c.cell = _cell)").withColumn("_part", F.expr("size(filter(_cuts, c -> c.cell < _cell))"))
    # Written, as ranking reads them several times and each time would read all rows.
    checkpoint_dir(spark)
    near = marked.filter("exists(_cuts, c -> c.cell = _cell)").withColumn("_from", F.expr("filter(_cuts, c -> c.cell = _cell)[0].before")).checkpoint()
    ranked = with_position(near, [*names, "_cell"], ["_h", key], "_i", digests=["_h"]).withColumn("_part", F.expr("size(filter(_cuts, c -> c.bound <= _from + _i))"))
    columns = [*rows.columns, "_part", "_n"]
    return apart.select(*columns).unionByName(ranked.select(*columns))


def repeated_random_folds(df: DataFrame, k: int, valid_frac: float, test_frac: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Independent permutations per fold, cut into test, valid and train."""
    if not (0 < valid_frac < 1 and 0 < test_frac < 1 and valid_frac + test_frac < 1):
        raise ValueError("fractions must be in (0, 1) and leave room for training")
    rows = df.select(F.col(row_idx).cast("long").alias("row_idx"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    def sizes(n: Column) -> tuple[Column, Column]:
        return F.rint(n * F.lit(test_frac)), F.rint(n * F.lit(valid_frac))

    placed = _parted(rows, ["fold"], F.col("fold") + F.lit(seed), "row_idx", lambda n: [sizes(n)[0], sizes(n)[0] + sizes(n)[1]])
    test, valid = sizes(F.col("_n"))
    short = (test < 1) | (valid < 1) | (test + valid >= F.col("_n"))
    split = (
        F.when(short, F.raise_error(F.lit("a split would be empty")).cast("string"))
        .when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "valid").otherwise("train")
    )
    return placed.select("fold", split.alias("split"), "row_idx")


def sliced_random_folds(df: DataFrame, k: int, seed: int = 42, row_idx: str = "row_idx", test_frac: float = 0.2, valid_frac: float = 0.1) -> DataFrame:
    """One permutation cut into k test slices, the last takes the remainder; valid from the reshuffled rest."""
    def step(n: Column) -> Column:
        return F.floor(n * F.lit(test_frac))

    base = _parted(df.select(F.col(row_idx).cast("long").alias("row_idx")), [], seed, "row_idx", lambda n: [step(n) * j for j in range(1, k)])
    # Without a step there are no slices.
    home = F.when(step(F.col("_n")) > 0, F.col("_part")).otherwise(F.lit(k - 1))
    every = base.select("row_idx", home.alias("home"), F.floor(F.col("_n") * F.lit(valid_frac)).alias("want"),
                        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    rest = every.filter("fold <> home")
    rest = _parted(rest, ["fold", "want"], F.concat(F.lit("rest"), (F.col("fold") + F.lit(seed)).cast("string")), "row_idx", lambda n: [F.col("want")])
    split = F.when(F.col("_part") == 0, "valid").otherwise("train")
    return rest.select("fold", split.alias("split"), "row_idx").unionByName(
        every.filter("fold = home").select("fold", F.lit("test").alias("split"), "row_idx"))


def fold_clusters(splits: DataFrame, df: DataFrame, cluster: str, row_idx: str = "row_idx") -> DataFrame:
    """The clusters of each split as a long table ``fold, split, cluster`` (cluster lists of G6)."""
    rows = with_cluster(df, cluster, row_idx, "unknown")
    return splits.join(rows, "row_idx").select("fold", "split", "cluster").distinct()


def _clamped(frac: float) -> Callable[[Column], list[Column]]:
    """The bound after a share of the rows, at least one row and not all."""
    return lambda n: [F.least(F.greatest(F.lit(1), F.rint(n * F.lit(frac))), n - 1)]


def _row_valid(rest: DataFrame, valid_frac: float, seed: int) -> DataFrame:
    """Row-level validation sample of each fold's rest: smallest hashes, size clamped to [1, n-1]."""
    placed = _parted(rest, ["fold"], F.concat(F.lit("valid"), (F.col("fold") + F.lit(seed)).cast("string")), "row_idx", _clamped(valid_frac))
    return placed.select("fold", F.when(F.col("_part") == 0, "valid").otherwise("train").alias("split"), "row_idx")


def cluster_slice_folds(df: DataFrame, cluster: str, k: int, valid_frac: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Shuffled clusters cut by count into k slices; row-level valid sample (G8). Missing clusters are single rows."""
    rows = with_cluster(df, cluster, row_idx, "row")
    checkpoint_dir(df.sparkSession)
    # Slice j starts at the first position i with floor(((i + 1) k - 1) / n) = j.
    order = _parted(rows.select("cluster").distinct().checkpoint(), [], seed, "cluster", lambda n: [F.floor(n * j / F.lit(k)) for j in range(1, k)])
    homes = rows.join(order.select("cluster", F.col("_part").alias("home")), "cluster").select("row_idx", "home").checkpoint()
    every = homes.select("row_idx", "home", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    rest = _row_valid(every.filter("fold <> home").select("fold", "row_idx"), valid_frac, seed)
    return rest.unionByName(every.filter("fold = home").select("fold", F.lit("test").alias("split"), "row_idx"))


def cluster_single_split(df: DataFrame, cluster: str, valid_frac: float, test_frac: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Test = a share of the shuffled clusters, valid = a row sample of the rest."""
    rows = with_cluster(df, cluster, row_idx, "row")
    checkpoint_dir(df.sparkSession)
    order = _parted(rows.select("cluster").distinct().checkpoint(), [], seed, "cluster", _clamped(test_frac))
    placed = rows.join(order.select("cluster", (F.col("_part") == 0).alias("_test")), "cluster").select(F.lit(0).alias("fold"), "row_idx", "_test").checkpoint()
    rest = _row_valid(placed.filter(~F.col("_test")).select("fold", "row_idx"), valid_frac, seed)
    return rest.unionByName(placed.filter("_test").select("fold", F.lit("test").alias("split"), "row_idx"))


def _kfold_starts(k: int) -> Callable[[Column], list[Column]]:
    """Where the folds of a shuffled order start, after the first: the first N mod k folds hold one row more."""
    return lambda n: [F.floor(n / F.lit(k)) * j + F.least(F.lit(j), n % k) for j in range(1, k)]


def random_kfold(df: DataFrame, k: int, train_share: float = 0.8, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Shuffled k-fold with an inner train/valid cut; ``k = 1`` gives one 64/16/20 split."""
    base = _parted(df.select(F.col(row_idx).cast("long").alias("row_idx")), [], seed, "row_idx",
                   (lambda n: [F.floor(n * F.lit(0.8))]) if k == 1 else _kfold_starts(k))
    if k == 1:
        outer = base.select("row_idx", F.lit(0).alias("fold"), (F.col("_part") == 1).alias("_test"))
    else:
        homes = base.select("row_idx", F.col("_part").alias("home"))
        outer = homes.select("row_idx", "home", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).select(
            "row_idx", "fold", (F.col("home") == F.col("fold")).alias("_test"))
    rest = _parted(outer.filter(~F.col("_test")).select("fold", "row_idx"), ["fold"], F.concat(F.lit("inner"), F.col("fold").cast("string")), "row_idx",
                   lambda n: [F.floor(n * F.lit(train_share))])
    split = F.when(F.col("_part") == 0, "train").otherwise("valid")
    return rest.select("fold", split.alias("split"), "row_idx").unionByName(
        outer.filter("_test").select("fold", F.lit("test").alias("split"), "row_idx"))


def default_cv(df: DataFrame, k: int, group: str | None = None, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Group folds with group-aware validation, else shuffled folds.

    Falls back to shuffled folds when there are fewer groups than folds, and to
    a 90/10 row cut inside a fold whose rest is a single group.
    """
    if group is None or k < 2:
        return random_kfold(df, k, 0.8, seed, row_idx)
    rows = with_cluster(df, group, row_idx)
    clusters = _sizes(rows)
    hist = _histogram(clusters)
    if sum(hist.values()) < k:
        return random_kfold(df, k, 0.8, seed, row_idx)
    tested, got, _ = _cluster_kfold(clusters, hist, k, seed, count_ties=True)
    plan = {f: _closest_fold(_pools(got, f), 0.1) for f in range(k) if sum(_pools(got, f).values()) > 1}
    seeds = {f: seed + f + 1 for f in range(k)}
    out = _attach(rows, _with_inner(tested, k, plan, seeds))
    lone = [f for f in range(k) if f not in plan]
    if not lone:
        return out
    rest = rows.join(tested.select("cluster", "test_fold"), "cluster").select(
        "row_idx", "test_fold", F.explode(F.array(*[F.lit(f) for f in lone])).alias("fold")).filter("fold <> test_fold")
    placed = _parted(rest.select("fold", "row_idx"), ["fold"], F.col("fold") + F.lit(seed + 1), "row_idx", lambda n: [F.floor(n * F.lit(0.9))])
    split = F.when(F.col("_part") == 0, "train").otherwise("valid")
    return out.unionByName(placed.select("fold", split.alias("split"), "row_idx"))


def train_valid_random(df: DataFrame, frac: float, seed: int = 42, row_idx: str = "row_idx") -> DataFrame:
    """Shuffled holdout, size clamped to [1, n-1]; a zero fraction or one row gives none."""
    rows = df.select(F.col(row_idx).cast("long").alias("row_idx"))
    placed = _parted(rows, [], seed, "row_idx", _clamped(frac) if frac > 0 else lambda n: [F.lit(0)])
    return placed.select(F.when(F.col("_part") == 0, "valid").otherwise("train").alias("split"), "row_idx")


def allocate(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Largest-remainder allocation per stratum, ties by name."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_rows"))
    n = counts.agg(F.sum("_rows").alias("_all"))
    exact = attach_row(counts, n)
    exact = exact.withColumn("_exact", F.col("_rows") / F.col("_all") * F.lit(total)).withColumn("_base", F.floor("_exact"))
    exact = exact.withColumn("_rest", F.col("_base") - F.col("_exact")).withColumn("_name", F.col(stratum).cast("string"))
    ranked = with_position(exact, [], ["_rest", "_name"], "_i")
    out = attach_row(ranked, ranked.agg((F.lit(total) - F.sum("_base")).alias("_spare")))
    took = F.col("_base") + F.when(F.col("_i") < F.col("_spare"), 1).otherwise(0)
    checked = (
        F.when(F.lit(total) >= F.col("_all"), F.raise_error(F.lit("sample must be smaller than the data")).cast("long"))
        .when(took > F.col("_rows"), F.raise_error(F.lit("stratum is too small")).cast("long")).otherwise(took)
    )
    return out.select(stratum, F.col("_rows").alias("rows"), checked.cast("long").alias("take"))


def stratified_sample(df: DataFrame, stratum: str, total: int, row_id: str, seed: int = 42) -> DataFrame:
    """Proportional sample without replacement, smallest hashes first."""
    keyed = df.withColumn("_h", hash_key(seed, F.col(row_id)))
    placed = with_position(keyed, [stratum], ["_h"], "_i").drop("_h")
    picked = placed.join(allocate(df, stratum, total), stratum).filter(F.col("_i") < F.col("take"))
    return picked.select(*df.columns)


# ------------------------------------------------------------------ bins

def bin_count(n: Column, max_bins: int, rule: str = "standard") -> Column:
    """Number of diagnostic bins by row count."""
    if rule == "small_table":
        return F.when(n < 30, 3).when(n < 100, 4).when(n < 200, 5).otherwise(F.least(F.lit(max_bins), F.greatest(F.lit(3), F.floor(n / F.lit(30)))))
    return F.when(n < 30, 3).when(n < 100, 4).otherwise(F.least(F.lit(max_bins), F.greatest(F.lit(3), F.floor(n / F.lit(20)))))


def grouped_quantiles(df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group from value histograms, one column per fraction."""
    from .metrics import _named, _runs

    rows = df.select(group_key(groups).alias("_g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    runs = _runs(rows.select("_g", F.coalesce("v", F.lit(0.0)).alias("v")).groupBy("_g", "v").agg(F.count(F.lit(1)).alias("n")), ["_g"], "v", ["n"])
    aggs, out = [], []
    for i, (name, q) in enumerate(fractions.items()):
        spot = (F.col("total_n") - 1) * F.lit(float(q))
        for tag, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            aggs.append(F.max(F.when((F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n")), F.col("v"))).alias(f"_{tag}{i}"))
        part = (F.col("_n") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (part - F.floor(part))).alias(name))
    return runs.groupBy("_g").agg(F.max("total_n").alias("_n"), *aggs).select(*_named(groups), *out)


def order_statistics(df: DataFrame, value: str, fractions: Column) -> DataFrame:
    """One row with the linearly interpolated quantiles of ``value`` and its count.

    Works on the value histogram; only the order statistics that are asked for
    reach the final aggregate.
    """
    from .metrics import _runs

    h = df.filter(F.col(value).isNotNull()).select(F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    runs = _runs(h, [], "v", ["n"]).withColumn("_f", fractions)
    spot = "_q * (total_n - 1)"
    lo = F.expr(f"transform(_f, _q -> if(before_n <= floor({spot}) AND floor({spot}) < before_n + n, v, NULL))")
    hi = F.expr(f"transform(_f, _q -> if(before_n <= ceil({spot}) AND ceil({spot}) < before_n + n, v, NULL))")
    width = F.expr("size(_f)")
    needed = runs.select("total_n", "_f", F.posexplode(F.arrays_zip(lo.alias("lo"), hi.alias("hi"))).alias("i", "s")).filter("s.lo IS NOT NULL OR s.hi IS NOT NULL")
    per = needed.groupBy("i").agg(
        F.max("total_n").alias("n"), F.max("s.lo").alias("lo"), F.max("s.hi").alias("hi"), F.first(F.expr("_f[i]")).alias("q"))
    part = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    per = per.select("i", "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("v"))
    return per.agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(i, v))), s -> s.v)").alias("quantiles"))


def qcut_bins(df: DataFrame, value: str, max_bins: int = 5, rule: str = "standard", out: str = "bin") -> DataFrame:
    """Quantile bins, right-closed, duplicate edges dropped.

    Null values get a null bin. If all quantiles coincide there is one edge and
    rows fall into equal-width bins, which for a constant column is one bin.
    """
    n = bin_count(F.col("total_n"), max_bins, rule)
    fractions = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: i / n.cast("double"))
    edges = order_statistics(df, value, fractions).select(F.array_distinct("quantiles").alias("_edges"))
    rows = attach_row(df, edges)
    # First edge at or above the value closes its bin; the lowest value belongs to bin 0.
    spot = F.expr(f"greatest(size(filter(_edges, e -> e < {value})), 1) - 1")
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), spot)).drop("_edges")


def rank_bins(df: DataFrame, value: str, row_idx: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal blocks of ranks, the fallback of one source."""
    placed = with_position(df.filter(F.col(value).isNotNull()), [], [value, row_idx], "_i", total="_n")
    block = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(bins)))
    return placed.withColumn(out, F.least(F.floor(F.col("_i") / block), F.lit(bins - 1)).cast("int")).drop("_i", "_n")


def width_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal-width bins, right-closed."""
    rows = attach_row(df, df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    spot = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.ceil((F.col(value) - F.col("_lo")) / F.nullif(step, F.lit(0.0))) - 1)
    return rows.withColumn(out, F.least(F.greatest(spot, F.lit(0)), F.lit(bins - 1)).cast("int")).drop("_lo", "_hi")


# ------------------------------------------------------------------ checks and views

def check_leakage(splits: DataFrame, df: DataFrame, keys: Sequence[str], row_idx: str = "row_idx") -> DataFrame:
    """Overlap counts of ids and of every key for the three split pairs of each fold."""
    named = splits.join(df.select(F.col(row_idx).cast("long").alias("row_idx"), *keys), "row_idx")
    values = F.array(
        F.struct(F.lit("row_idx").alias("what"), F.col("row_idx").cast("string").alias("value")),
        *[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in keys])
    seen = named.select("fold", "split", F.inline(values)).filter("value IS NOT NULL").groupBy("fold", "what", "value").agg(
        *[F.bool_or(F.col("split") == s).alias(s) for s in ("train", "valid", "test")])
    both = {"train_valid": ("train", "valid"), "train_test": ("train", "test"), "valid_test": ("valid", "test")}
    return seen.groupBy("fold", "what").agg(*[F.count_if(F.col(a) & F.col(b)).alias(n) for n, (a, b) in both.items()])


def split_summary(splits: DataFrame, df: DataFrame, cluster: str, row_idx: str = "row_idx") -> DataFrame:
    """Rows, clusters, largest cluster and shares per fold and split."""
    named = splits.join(df.select(F.col(row_idx).cast("long").alias("row_idx"), F.col(cluster).alias("_c")), "row_idx")
    per = named.groupBy("fold", "split", "_c").agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col("_c").isNotNull(), F.col("_n"))
    out = per.groupBy("fold", "split").agg(
        F.sum("_n").alias("rows"), F.count("_c").alias("clusters"), F.coalesce(F.max(known), F.lit(0)).alias("largest_cluster"))
    whole = out.groupBy("fold").agg(F.sum("rows").alias("_all"))
    return out.join(whole, "fold").select(
        "fold", "split", "rows", "clusters", "largest_cluster",
        (F.col("largest_cluster") / F.col("rows") * 100).alias("largest_pct"), (F.col("rows") / F.col("_all") * 100).alias("rows_pct"))


def fingerprint(df: DataFrame, columns: Sequence[str], row_idx: str = "row_idx") -> DataFrame:
    """Order-sensitive checksum of the table from per-row digests (G18): ``(size, fingerprint)``."""
    text = F.concat_ws("\u001f", F.col(row_idx).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("size"), F.sum(part.cast("decimal(28,0)")).cast("string").alias("fingerprint"))


def validate_splits(df: DataFrame, splits: DataFrame, meta: DataFrame, columns: Sequence[str], row_idx: str = "row_idx") -> DataFrame:
    """One row with the checks of a split file against its table.

    The size must be present and equal; the fingerprint is compared when the
    file has one; there must be folds.
    """
    said = meta.agg(F.max("size").alias("said_size"), F.max("fingerprint").alias("said_fingerprint"))
    folds = splits.agg(F.countDistinct("fold").alias("folds"))
    row = attach_row(attach_row(fingerprint(df, columns, row_idx), said), folds)
    return row.select(
        "size", "said_size", "folds",
        F.coalesce(F.col("size") == F.col("said_size"), F.lit(False)).alias("size_ok"),
        F.when(F.col("said_fingerprint").isNotNull(), F.col("fingerprint") == F.col("said_fingerprint")).alias("fingerprint_ok"),
        (F.col("folds") > 0).alias("folds_ok"),
    )


def require_valid(checks: DataFrame) -> DataFrame:
    """The checks row, or an error when a mandatory check fails."""
    bad = ~F.col("size_ok") | ~F.col("folds_ok") | ~F.coalesce(F.col("fingerprint_ok"), F.lit(True))
    message = F.format_string("split file does not fit the table: size %d against %d, folds %d", "said_size", "size", "folds")
    return checks.withColumn("ok", F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def materialize_fold(df: DataFrame, splits: DataFrame, fold: int, row_idx: str = "row_idx") -> DataFrame:
    """Rows of one fold with their split."""
    chosen = splits.filter(F.col("fold") == fold).select("split", F.col("row_idx").alias(row_idx))
    return df.join(chosen, row_idx)


def fold_entry_ids(df: DataFrame, splits: DataFrame, entry: str, row_idx: str = "row_idx") -> DataFrame:
    """Split rows with their entry ids (G21), as the long table that the split sink writes."""
    return splits.join(df.select(F.col(row_idx).cast("long").alias("row_idx"), F.col(entry).alias("entry_id")), "row_idx").select(
        "fold", "split", "row_idx", "entry_id")



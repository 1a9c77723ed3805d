"""Ranking and regression metrics per group.

All ranks come from value histograms (``group, value, count``) and
:func:`running_before`, so an oversized group is never sorted in one task.
Metrics return one row per group; an undefined metric is null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import group_key, magnitude_cell, running_before, with_positions
from ..session import checkpoint_dir

# Floor of KD values inside ratios, and the top fraction of a ranking.
KD_FLOOR = 1e-12
HIT_SIZES = (10, 20, 50, 100)


def to_number(c: Column) -> Column:
    """Lenient numeric coercion: anything that is not a number becomes null."""
    v = c.try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def numeric_pairs(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Coerce label and prediction, drop incomplete rows (empty groups vanish)."""
    return (
        df.withColumn(label, to_number(F.col(label)))
        .withColumn(pred, to_number(F.col(pred)))
        .dropna(subset=[label, pred])
    )


def _keyed_pairs(df: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Complete rows as ``(_g, y, p)``; the coalesce only declares them non-null."""
    rows = df.select(group_key(groups).alias("_g"), F.col(label).alias("y"), F.col(pred).alias("p")).dropna(subset=["y", "p"])
    return rows.select("_g", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("p", F.lit(0.0)).alias("p"))


def _named(groups: Sequence[str]) -> list[Column]:
    return [F.col("_g")[c].alias(c) for c in groups]


def _runs(h: DataFrame, groups: list[str], value: str, weights: list[str]) -> DataFrame:
    """Value runs of each group with running totals of ``weights``."""
    cell = f"_{value}_cell"
    return running_before(h.withColumn(cell, magnitude_cell(F.col(value))), groups, [cell, value], weights).drop(cell)


def _average_rank(n: str = "n") -> Column:
    return F.col(f"before_{n}") + (F.col(n) + F.lit(1.0)) / F.lit(2.0)


def _in_top_tenth(n: str = "n") -> Column:
    """Is the run at or above the linearly interpolated 90th percentile?

    The percentile sits at order position 0.9(N-1). A value reaches it exactly
    when its run covers position ceil(0.9(N-1)) or lies above it.
    """
    needed = F.ceil((F.col(f"total_{n}") - 1) * F.lit(9) / F.lit(10.0))
    return (F.col(f"before_{n}") + F.col(n)) > needed


# Five-point Gauss-Legendre nodes and weights on [-1, 1].
GAUSS_NODES = (-0.9061798459386640, -0.5384693101056831, 0.0, 0.5384693101056831, 0.9061798459386640)
GAUSS_WEIGHTS = (0.2369268850561891, 0.4786286704993665, 0.5688888888888889, 0.4786286704993665, 0.2369268850561891)


def discount_sum(first: str, last: str) -> Column:
    """Sum of 1/log2(i+1) for i = first..last (0 when empty), at constant cost.

    Up to 4 096 terms are added directly. A longer run adds its terms below
    position 64 directly and takes the rest from the Euler-Maclaurin formula;
    the integral is taken in log space on quarter-unit pieces by Gauss-Legendre
    quadrature.
    """
    direct, smooth = 4096, 64

    def add(a: str, b: str) -> str:
        return f"aggregate(sequence({a}, greatest({a}, {b})), 0D, (s, i) -> s + if(i <= {b}, 1D / log2(i + 1D), 0D))"

    lo = f"greatest({first}, {smooth}L)"
    width = f"ln(({last} + 1D) / ({lo} + 1D))"
    pieces = f"greatest(cast(ceil({width} / 0.25D) as int), 1)"
    half = f"({width} / (2D * {pieces}))"
    point = f"(ln({lo} + 1D) + {half} * (2D * k + 1D + %rD))"
    quadrature = " + ".join(f"{w}D * exp({point % x}) / {point % x}" for x, w in zip(GAUSS_NODES, GAUSS_WEIGHTS, strict=True))
    integral = f"(ln(2D) * {half} * aggregate(sequence(0, {pieces} - 1), 0D, (s, k) -> s + {quadrature}))"

    def slope(i: str) -> str:
        return f"(-ln(2D) / (({i} + 1D) * pow(ln({i} + 1D), 2)))"

    ends = f"(1D / log2({lo} + 1D) + 1D / log2({last} + 1D)) / 2D + ({slope(last)} - {slope(lo)}) / 12D"
    short_last = f"least({last}, {first} + {direct})"
    return F.expr(
        f"CASE WHEN {last} < {first} THEN 0D WHEN {last} - {first} < {direct} THEN {add(first, short_last)} "
        f"ELSE if({first} < {smooth}, {add(first, f'least({last}, {smooth - 1}L, {first} + {smooth})')}, 0D) + {integral} + {ends} END"
    )


def ranking_metrics(df: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Spearman, AUC, MCC, NDCG@N/10, average precision and N per group.

    One joint histogram, one join of label ranks onto it, one regrouping by
    prediction; every later step only adds up partial sums.
    """
    joint = _keyed_pairs(df, groups, label, pred).groupBy("_g", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    by_label = _runs(joint.groupBy("_g", "y").agg(F.sum("n").alias("n")), ["_g"], "y", ["n"])
    by_label = by_label.select(
        "_g", "y", "n", "before_n", "total_n",
        _average_rank().alias("rank"), _in_top_tenth().cast("long").alias("pos"),
    )
    cells = joint.join(by_label.select("_g", "y", "rank", "pos"), ["_g", "y"])
    by_pred = _runs(
        cells.groupBy("_g", "p").agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("pos")).alias("npos"),
            F.sum(F.col("n") * F.col("rank")).alias("gain"),
        ),
        ["_g"], "p", ["n", "npos", "gain"],
    )

    n = F.col("n")
    center = (F.col("total_n") + 1.0) / 2.0
    after_n = F.col("total_n") - F.col("before_n") - n
    first = "(total_n - before_n - n + 1)"
    last = "least(total_n - before_n, greatest(1L, cast(floor(total_n / 10) as bigint)))"
    label_part = by_label.select(
        "_g",
        F.col("total_n").alias("total"),
        (n * F.pow(F.col("rank") - center, 2)).alias("syy"),
        F.col("rank").alias("rank_y"),
        (n * F.col("pos")).alias("actual"),
        (F.col("rank") * discount_sum(first, last)).alias("ideal"),
    )
    hits_above = F.col("total_npos") - F.col("before_npos")
    # Centered gain of all higher predictions; with it the rank product sum
    # needs no second look at the prediction ranks.
    gain_above = F.col("total_gain") - F.col("before_gain") - F.col("gain") - after_n * center
    own_gain = F.col("gain") - n * center
    pred_pos = _in_top_tenth().cast("long")
    pred_part = by_pred.select(
        "_g",
        (n * F.pow(_average_rank() - center, 2)).alias("spp"),
        (n * gain_above + own_gain * n / 2.0).alias("spy"),
        _average_rank().alias("rank_p"),
        (F.col("npos") * _average_rank()).alias("pos_rank"),
        (n * pred_pos).alias("called"),
        (F.col("npos") * pred_pos).alias("true_called"),
        (F.col("gain") / n * discount_sum(first, last)).alias("dcg"),
        (F.col("npos") / F.col("total_npos") * (hits_above / (after_n + n))).alias("precision_step"),
    )
    g = label_part.unionByName(pred_part, allowMissingColumns=True).groupBy("_g").agg(
        F.max("total").alias("n"),
        *[F.sum(c).alias(c) for c in (
            "syy", "spp", "spy", "actual", "called", "true_called", "pos_rank", "ideal", "dcg", "precision_step")],
        (F.min("rank_y") == F.max("rank_y")).alias("flat_y"),
        (F.min("rank_p") == F.max("rank_p")).alias("flat_p"),
    )
    total, pos, called, tp = (F.col(c).cast("double") for c in ("n", "actual", "called", "true_called"))
    neg = total - pos
    mcc_scale = pos * neg * called * (total - called)
    return g.select(
        *_named(groups),
        F.col("n"),
        F.when(~F.col("flat_y") & ~F.col("flat_p"), F.col("spy") / F.sqrt(F.col("syy") * F.col("spp"))).alias("spearman"),
        F.when(neg > 0, (F.col("pos_rank") - pos * (pos + 1.0) / 2.0) / F.nullif(pos * neg, F.lit(0.0))).alias("auc"),
        F.when(mcc_scale > 0, (tp * total - pos * called) / F.sqrt(F.nullif(mcc_scale, F.lit(0.0)))).otherwise(0.0).alias("mcc"),
        (F.col("dcg") / F.col("ideal")).alias("ndcg"),
        F.col("precision_step").alias("ap"),
    )


def spearman(df: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Spearman correlation only (E1); unused sums are pruned by the optimizer."""
    return ranking_metrics(df, groups, label, pred).select(*groups, "n", "spearman")


def _pearson(label: str, pred: str) -> Column:
    scale = F.stddev_pop(label) * F.stddev_pop(pred)
    flat = (F.min(label) == F.max(label)) | (F.min(pred) == F.max(pred))
    return F.when(~flat, F.covar_pop(label, pred) / F.nullif(scale, F.lit(0.0)))


def pearson(df: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Pearson correlation (E2); null when either side does not vary."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), _pearson(label, pred).alias("pearson"))


def top_bottom_hits(
    df: DataFrame, groups: Sequence[str], label: str, pred: str, row_id: str, sizes: Sequence[int] = HIT_SIZES, window_rows: int | None = None
) -> DataFrame:
    """TopHit@k, BottomHit@k and UnbiasHit@k.

    Rows are ordered by label (ties by ``row_id``). With ``top`` rows of rank
    fraction >= 0.9, the ``top`` lowest predictions are discarded first; top
    hits are counted at the end of the remainder, bottom hits at its start.
    Prediction ties keep label order. Both orders of a group come from one shuffle.
    """
    groups = list(groups)
    base = df.select(*groups, F.col(label).alias("_y"), F.col(pred).alias("_p"), F.col(row_id).alias("_id"))
    placed = with_positions(base, groups, {"_r": ["_y", "_id"], "_q": ["_p", "_r"]}, total="_n", window_rows=window_rows)
    # Rank fractions r/N >= 0.9 and r/N < 0.1 in whole numbers.
    top = F.col("_n") - F.ceil(F.col("_n") * 9 / F.lit(10.0))
    bottom = F.ceil(F.col("_n") / F.lit(10.0))
    rows = placed.select(*groups, "_n", "_r", "_q", top.alias("_top"), bottom.alias("_bottom"))
    aggs = []
    for k in sizes:
        head = F.least(F.lit(k), F.col("_top"))
        tail_from = F.when(F.col("_top") == 0, F.lit(0)).otherwise(F.col("_n") - head)
        aggs.append(F.avg(F.when(F.col("_q") >= tail_from, (F.col("_r") >= F.col("_n") - F.col("_top")).cast("double"))).alias(f"top_hit_{k}"))
        in_head = (F.col("_q") >= F.col("_top")) & (F.col("_q") < F.col("_top") + F.least(head, F.col("_bottom")))
        aggs.append(F.avg(F.when(in_head, (F.col("_r") < F.col("_bottom")).cast("double"))).alias(f"bottom_hit_{k}"))
    out = rows.groupBy(*groups).agg(F.max("_n").alias("n"), *aggs)
    return out.select("*", *[(F.col(f"top_hit_{k}") - F.col(f"bottom_hit_{k}")).alias(f"unbias_hit_{k}") for k in sizes])


def per_file_correlation(
    df: DataFrame, file_col: str, label: str = "DMS_score",
    score_preference: Sequence[str] = ("wt_score", "masked_score"), files: DataFrame | None = None,
) -> DataFrame:
    """Pearson and Spearman per file with a status.

    ``score_preference`` lists the score columns, best first; a file takes the
    first one it has at all. Whether it has one is known from ``files``
    (``file_col``, ``columns``: the header names of each file), which then lists the
    files of the output, also those without rows; without ``files`` a column
    that is null in every row of a file counts as absent. Files lacking label or score, and files without variance, stay in the
    output with a status. Presence and Pearson come from one aggregate, the ranks from a second read.
    """
    present = [c for c in score_preference if c in df.columns]
    if label not in df.columns or not present:
        return (df if files is None else files).select(file_col).distinct().select(
            file_col, F.lit(None).cast("double").alias("pearson"), F.lit(None).cast("double").alias("spearman"),
            F.lit("missing").alias("status"))
    numbers = [F.col(file_col), to_number(F.col(label)).alias("_y")]
    for i, c in enumerate(present):
        numbers += [to_number(F.col(c)).alias(f"_p_{i}"), F.col(c).isNotNull().alias(f"_given_{i}")]
    rows = df.select(*numbers, F.col(label).isNotNull().alias("_given"))
    stats = [F.bool_or("_given").alias("_has_label")]
    for i in range(len(present)):
        y = F.when(F.col(f"_p_{i}").isNotNull(), F.col("_y"))
        p = F.when(F.col("_y").isNotNull(), F.col(f"_p_{i}"))
        stats += [F.bool_or(f"_given_{i}").alias(f"_has_{i}"), _pearson(y, p).alias(f"_r_{i}")]
    found = rows.groupBy(file_col).agg(*stats)
    if files is not None:
        flags = {"_has_label": F.array_contains("columns", label)} | {f"_has_{i}": F.array_contains("columns", c) for i, c in enumerate(present)}
        named = files.select(file_col, *[has.alias(c) for c, has in flags.items()])
        found = named.join(found.drop(*flags), file_col, "left")
    which = F.coalesce(*[F.when(F.col(f"_has_{i}"), F.lit(i)) for i in range(len(present))])
    found = found.withColumn("_which", which).withColumn("pearson", F.coalesce(*[F.when(F.col("_which") == i, F.col(f"_r_{i}")) for i in range(len(present))]))
    chosen = found.select(file_col, "_has_label", "_which", "pearson")
    score = F.coalesce(*[F.when(F.col("_which") == i, F.col(f"_p_{i}")) for i in range(len(present))])
    pairs = rows.join(chosen, file_col).select(file_col, "_y", score.alias("_p")).dropna(subset=["_y", "_p"])
    ranked = spearman(pairs, [file_col], "_y", "_p").drop("n")
    absent = ~F.col("_has_label") | F.col("_which").isNull()
    status = F.when(absent, "missing").when(F.col("pearson").isNull(), "zero variance").otherwise("computed")
    return chosen.join(ranked, file_col, "left").select(file_col, F.when(~absent, F.col("pearson")).alias("pearson"), "spearman", status.alias("status"))


def regression_errors(df: DataFrame, groups: Sequence[str], truth: str, pred: str, null_pred_as_zero: bool = False) -> DataFrame:
    """MSE, RMSE, MAE and R2."""
    p = F.coalesce(F.col(pred), F.lit(0.0)) if null_pred_as_zero else F.col(pred)
    rows = df.select(*groups, F.col(truth).alias("t"), p.alias("p")).dropna(subset=["t", "p"])
    err = F.col("p") - F.col("t")
    g = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop("t") * F.count(F.lit(1))).alias("_sst"),
        (F.min("t") == F.max("t")).alias("_flat"),
    )
    r2 = (
        F.when(F.col("n") < 2, None)
        .when(F.col("_flat"), F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0)))
    )
    return g.select(*groups, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def concordance(df: DataFrame, groups: Sequence[str], truth: str, pred: str, eps: float = 1e-12) -> DataFrame:
    """Lin's concordance correlation (E13), population variances."""
    shift = F.pow(F.avg(truth) - F.avg(pred), 2)
    flat = (F.min(truth) == F.max(truth)) | (F.min(pred) == F.max(pred))
    ccc = 2.0 * F.covar_pop(truth, pred) / F.nullif(F.var_pop(truth) + F.var_pop(pred) + shift + F.lit(eps), F.lit(0.0))
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(~flat, ccc).alias("ccc"))


def fold_error(df: DataFrame, groups: Sequence[str], kd_true: str, kd_pred: str) -> DataFrame:
    """GMFE and the shares of predictions within two- and three-fold."""
    t, p = F.col(kd_true), F.col(kd_pred)
    log_ratio = F.abs(F.log(F.greatest(p, F.lit(KD_FLOOR)) / F.greatest(t, F.lit(KD_FLOOR))))
    ratio = F.greatest(t, p) / F.greatest(F.least(t, p), F.lit(KD_FLOOR))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.exp(F.avg(log_ratio)).alias("gmfe"),
        F.avg((ratio <= 2.0).cast("double")).alias("p2_within"),
        F.avg((ratio <= 3.0).cast("double")).alias("p3_within"),
    )


# Points of a strip that meet pair by pair.
PAIRED_POINTS = 128


def strip_inversions(i: np.ndarray, j: np.ndarray, w: np.ndarray, step: int = 1024) -> int:
    """Sum of ``w_a w_b`` over pairs with ``i_a < i_b`` and ``j_a > j_b``.

    In the order of ``j`` and ``i`` descending, a chunk meets the weights of earlier chunks
    through their running totals by ``i``, and its own points pair by pair.
    """
    _, i = np.unique(i, return_inverse=True)
    order = np.lexsort((-i, -j))
    i, j, w = i[order], j[order], w[order].astype(np.int64)
    before = np.zeros(i.max(initial=-1) + 2, np.int64)
    found = 0
    for at in range(0, len(i), step):
        a, b, c = i[at:at + step], j[at:at + step], w[at:at + step]
        found += int(c @ np.cumsum(before)[a])
        found += int(c @ (((a[:, None] < a[None, :]) & (b[:, None] > b[None, :])).astype(np.int64).T @ c))
        np.add.at(before, a + 1, c)
    return found


def _inversions(points: DataFrame, largest: int, block: int) -> DataFrame:
    """``_g, discordant`` in parts: weighted inversions of points ``(_g, i, j, n)``.

    ``i`` and ``j`` are places in two orders. Strips of ``block`` places in one
    order hold the pairs that are close in it; pairs that are close in neither
    order are pairs of the cells of a grid of strips, so the same count goes on
    with the grid until it is one strip wide. Each level moves its points twice.
    """
    import pandas as pd

    def strips(side: str):
        def count(part: pd.DataFrame) -> pd.DataFrame:
            i, j, w = (part[c].to_numpy() for c in ("i", "j", "n"))
            found = strip_inversions(i, j, w, PAIRED_POINTS)
            if side == "j":  # pairs close in both orders were counted with i
                order = np.argsort(i // block, kind="stable")
                cuts = np.flatnonzero(np.diff((i // block)[order])) + 1
                # Most cells hold one point, which has no pair.
                ends = [0, *cuts.tolist(), len(order)]
                found -= sum(strip_inversions(i[order[a:b]], j[order[a:b]], w[order[a:b]], PAIRED_POINTS) for a, b in zip(ends, ends[1:]) if b - a > 1)
            return pd.DataFrame({"_key": part["_key"].iloc[:1], "discordant": [float(found)]})
        return count

    out = None
    while True:
        keyed = points.select(F.to_json("_g", {"ignoreNullFields": "false"}).alias("_key"), "i", "j", "n")
        for side in ("i", "j"):
            part = keyed.groupBy("_key", F.floor(F.col(side) / block).alias("_strip")).applyInPandas(strips(side), "_key string, discordant double").select("_key", "discordant")
            out = part if out is None else out.unionByName(part)
            if largest <= block:
                return out  # one strip holds all
        largest = -(-largest // block)
        points = points.groupBy("_g", F.floor(F.col("i") / block).alias("i"), F.floor(F.col("j") / block).alias("j")).agg(F.sum("n").alias("n")).checkpoint()


def kendall_tau(df: DataFrame, groups: Sequence[str], truth: str, pred: str, block: int = 1024, window_rows: int | None = None) -> DataFrame:
    """Kendall tau-b.

    In the order of truth (ties by prediction) and the order of prediction
    (ties by truth), a pair is discordant exactly if the two orders disagree
    about it. Discordant pairs are counted as inversions in strips of ``block``
    places, so rows are shuffled a few times each, whatever their number.
    """
    checkpoint_dir(df.sparkSession)
    pairs_in = _keyed_pairs(df, groups, truth, pred).withColumnsRenamed({"y": "x", "p": "y"})
    cells = pairs_in.groupBy("_g", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    # Each strip and each tie count reads the places, so they are written once.
    placed = with_positions(cells, ["_g"], {"i": ["x", "y"], "j": ["y", "x"]}, window_rows=window_rows).checkpoint()
    largest = (placed.agg(F.max("i")).first()[0] or 0) + 1
    names = placed.select(F.to_json("_g", {"ignoreNullFields": "false"}).alias("_key"), "_g").groupBy("_key").agg(F.first("_g").alias("_g"))
    counted = _inversions(placed.select("_g", "i", "j", "n"), largest, block).groupBy("_key").agg(F.sum("discordant").alias("discordant"))

    def pairs(c: str) -> Column:
        return F.col(c).cast("double") * (F.col(c) - 1) / 2.0

    ties = lambda *c: placed.groupBy("_g", *c).agg(F.sum("n").alias("n"))
    parts = (
        ties("x").select("_g", pairs("n").alias("tie_x"), F.col("n").alias("rows"))
        .unionByName(ties("y").select("_g", pairs("n").alias("tie_y")), allowMissingColumns=True)
        .unionByName(placed.select("_g", pairs("n").alias("tie_xy")), allowMissingColumns=True)
        .unionByName(counted.join(names, "_key").select("_g", "discordant"), allowMissingColumns=True)
    )
    g = parts.groupBy("_g").agg(
        F.sum("rows").alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("discordant", "tie_x", "tie_y", "tie_xy")])
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2.0
    concordant_minus = every - F.col("tie_x") - F.col("tie_y") + F.col("tie_xy") - 2.0 * F.col("discordant")
    scale = F.sqrt(every - F.col("tie_x")) * F.sqrt(every - F.col("tie_y"))
    return g.select(*_named(groups), "n", F.when(scale > 0, concordant_minus / F.nullif(scale, F.lit(0.0))).alias("kendall_tau"))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def fold_mean(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NaN-ignoring mean of every metric over folds."""
    return metrics.groupBy(*keys).agg(*[F.avg(nan_to_null(F.col(c))).alias(c) for c in columns])


def macro_average(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], subtotals: bool = False) -> DataFrame:
    """Mean metric and file count by the key columns (E17); ``subtotals`` rolls up."""
    grouped = metrics.rollup(*keys) if subtotals else metrics.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("files"), *[F.avg(nan_to_null(F.col(c))).alias(c) for c in columns])


def evaluate(df: DataFrame, keys: Sequence[str], label: str, pred: str, hits: bool = False, row_id: str | None = None) -> DataFrame:
    """All ranking metrics for every (model, file) in one job."""
    pairs = numeric_pairs(df, label, pred)
    out = ranking_metrics(pairs, keys, label, pred)
    if hits:
        if row_id is None:
            raise ValueError("hit metrics need a row id to break label ties")
        out = out.join(top_bottom_hits(pairs, keys, label, pred, row_id).drop("n"), list(keys))
    return out

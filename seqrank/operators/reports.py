"""Leaderboards, distribution summaries and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mutation_text import apply_mutations
from ..functions.ordering import attach_row, group_key, with_position
from . import metrics as M
from .scoring import with_toy_score
from .splits import grouped_quantiles


def fold_number(df: DataFrame, fold: str = "Fold") -> DataFrame:
    """Fold as an integer; anything else becomes 0."""
    if fold not in df.columns:
        return df
    return df.withColumn(fold, F.coalesce(F.col(fold).cast("string").try_cast("double").cast("int"), F.lit(0)))


def last_rows(parts: Sequence[DataFrame], keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Last row per key over numbered batches; later batches win, then ``order``."""
    tagged = [p.withColumn("_batch", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    columns = [c for c in every.columns if c != "_batch"]
    place = F.struct("_batch", order) if order else F.struct("_batch")
    best = every.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(F.struct(*columns), place).alias("_row"))
    return best.select("_row.*")


def upsert_summary(previous: DataFrame, new: DataFrame, keys: Sequence[str] = ("Model", "Net", "Fold"), order: str | None = None) -> DataFrame:
    """Append and keep the last row per model, net and fold."""
    return last_rows([fold_number(previous), fold_number(new)], [k for k in keys if k in new.columns], order)


def replace_model(previous: DataFrame, new: DataFrame, model: str = "Model") -> DataFrame:
    """Drop all earlier rows of the new models, then append."""
    kept = previous.join(new.select(model).distinct(), model, "left_anti")
    return fold_number(kept.unionByName(new, allowMissingColumns=True))


def rank_models(summary: DataFrame, metric: str = "Spearman", keys: Sequence[str] = ("Model", "Net")) -> DataFrame:
    """Mean metric per model, best first."""
    mean = F.avg(M.nan_to_null(F.col(metric))).alias(f"{metric}_mean")
    return summary.groupBy(*keys).agg(mean).orderBy(F.col(f"{metric}_mean").desc_nulls_last(), *keys)


def upsert_ranking(previous: DataFrame, new: DataFrame, metric: str = "Spearman", keys: Sequence[str] = ("Model", "Net")) -> DataFrame:
    """Ranking with replaced models, sorted again (I4)."""
    return last_rows([previous, new], keys).orderBy(F.col(f"{metric}_mean").desc_nulls_last(), *keys)


def label_summary(df: DataFrame, label: str, split: str = "split", splits: Sequence[str] = ()) -> DataFrame:
    """Count, moments and quartiles per split (I5); listed splits without rows get nulls."""
    rows = df.select(split, F.col(label).cast("double").alias("v")).filter(F.col("v").isNotNull())
    flat = F.min("v") == F.max("v")
    moments = rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.when(~flat, F.skewness("v")).alias("skew"), F.when(~flat, F.kurtosis("v")).alias("kurtosis"))
    quartiles = grouped_quantiles(rows, [split], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = moments.join(quartiles, split)
    if splits:
        names = df.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
        out = names.join(out, split, "left")
    return out.select(split, "n", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis")


def ecdf(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Cumulative share at every distinct value."""
    rows = df.select(group_key(groups).alias("_g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    h = rows.select("_g", F.coalesce("v", F.lit(0.0)).alias("v")).groupBy("_g", "v").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("before_n") + F.col("n")) / F.col("total_n")
    return M._runs(h, ["_g"], "v", ["n"]).select(*M._named(groups), F.col("v").alias(value), "n", share.alias("share"))


def ecdf_rows(df: DataFrame, value: str, row_idx: str, groups: Sequence[str] = ()) -> DataFrame:
    """Every sorted row with i/n."""
    placed = with_position(df.filter(F.col(value).isNotNull()), list(groups), [value, row_idx], "_i", total="_n")
    return placed.select(*groups, row_idx, value, ((F.col("_i") + 1) / F.col("_n")).alias("share"))


def histogram(df: DataFrame, value: str, bins: int = 40, groups: Sequence[str] = ()) -> DataFrame:
    """Fixed-edge histogram over the pooled range with density per group (I7); the last bin is closed."""
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v"))
    spread = attach_row(rows, rows.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    step = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.lit(bins)).otherwise(1.0 / bins)
    spot = F.least(F.floor((F.col("v") - F.col("_lo")) / step), F.lit(bins - 1)).cast("int")
    counts = spread.select(*groups, spot.alias("bin"), "_lo", step.alias("_step")).groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_step").alias("_step"))
    total = counts.groupBy(*groups).agg(F.sum("n").alias("_all"))
    joined = counts.join(total, list(groups)) if groups else attach_row(counts, total)
    return joined.select(
        *groups, "bin", (F.col("_lo") + F.col("bin") * F.col("_step")).alias("left_edge"), "n",
        (F.col("n") / (F.col("_all") * F.col("_step"))).alias("density"))


def cluster_size_histogram(df: DataFrame, cluster: str) -> DataFrame:
    """How many clusters have each size."""
    sizes = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def dataset_manifest(df: DataFrame, index: str, cluster: str, presence: Sequence[str] = (), params: Mapping[str, object] | None = None) -> DataFrame:
    """Manifest lines (I8): one ``summary`` line and one ``cluster`` line per cluster.

    Cluster counts stay rows, so any number of clusters is written in parallel.
    """
    flags = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"{c}_present") for c in presence]
    extra = [F.lit(v).alias(k) for k, v in (params or {}).items()]
    summary = df.agg(F.count(F.lit(1)).alias("rows"), F.min(index).alias("source_row_min"), F.max(index).alias("source_row_max"), *flags)
    head = summary.select(F.lit("summary").alias("kind"), F.to_json(F.struct(*summary.columns, *extra)).alias("line"))
    counts = df.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("rows"))
    return head.unionByName(counts.select(F.lit("cluster").alias("kind"), F.to_json(F.struct("cluster", "rows")).alias("line")))


def metrics_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics to (metric, value) rows."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def add_scores(df: DataFrame, weights: Mapping[str, float], row_id: str = "mutation_id", seq: str = "wildtype_sequence", mutant: str = "mutant", label: str = "DMS_score") -> DataFrame:
    """Demonstration output row: id, mutant, wild type, mutated sequence, label, score."""
    built = with_toy_score(df.withColumn("mutated_sequence", apply_mutations(seq, mutant)), weights, mutant)
    return built.select(row_id, mutant, seq, "mutated_sequence", F.col(label).cast("double").alias(label), "mock_score")

"""Frozen features, scaling and per-fold regression (H1-H8)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mutation_text import RESIDUES
from ..session import checkpoint_dir
from . import metrics as M

UNKNOWN = "X"
ALPHABET = RESIDUES + UNKNOWN


def composition_vector(seq: str) -> Column:
    """Mean one-hot vector over 20 residues and X; zeros for an empty sequence (H1).

    The whole sequence counts, after cleaning: letters only, upper case, X for
    every letter that is no residue.
    """
    known = f"regexp_replace(upper(regexp_replace(coalesce({seq}, ''), '[^A-Za-z]', '')), '[^{RESIDUES}]', '{UNKNOWN}')"
    letters = ", ".join(f"'{a}'" for a in ALPHABET)
    # The outer transform binds the cleaned text once for all letters.
    share = "if(s = '', 0D, (length(s) - length(replace(s, a, ''))) / length(s))"
    return F.expr(f"transform(array({known}), s -> transform(array({letters}), a -> {share}))[0]")


def property_vector(composition: str, table: Mapping[str, Sequence[float]]) -> Column:
    """Mean property vector from a composition vector and a property table (H2).

    ``table`` maps residues to equally long property rows; residues it lacks
    use its X row.
    """
    rows = [table.get(a, table[UNKNOWN]) for a in ALPHABET]
    width = len(rows[0])
    columns = [f"array({', '.join(repr(float(r[j])) + 'D' for r in rows)})" for j in range(width)]
    dot = [f"aggregate(zip_with({composition}, {c}, (x, y) -> x * y), 0D, (s, v) -> s + v)" for c in columns]
    return F.expr(f"array({', '.join(dot)})")


def pool_residues(res: DataFrame, key: str, mode: str = "mean", vec: str = "vec", mask: str | None = None, special: str | None = None) -> DataFrame:
    """Sequence vector from residue vectors (H3).

    ``mean`` is masked with a divisor of at least one, ``cls`` takes position
    0. Rows flagged by ``special`` are left out first.
    """
    rows = res.filter(~F.col(special)) if special else res
    if mode == "cls":
        return rows.filter("pos = 0").select(key, vec)
    if mode != "mean":
        raise ValueError(f"unknown mode {mode!r}")
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    used = rows.filter(F.col(vec).isNotNull()).select(key, weight.alias("_w"), vec)
    total = used.groupBy(key).agg(_vector_sum(F.transform(vec, lambda x: x.cast("double") * F.col("_w"))).alias("_s"), F.sum("_w").alias("_w"))
    return total.select(key, F.transform("_s", lambda x: x / F.greatest(F.col("_w"), F.lit(1.0))).alias(vec))


def _vector_sum(vec: Column) -> Column:
    """Element-wise sum of vectors of one length: a partial aggregate with one vector per key and task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def mean_vector(df: DataFrame, vec: str) -> DataFrame:
    """The mean of a vector column as one row, the stand-in for missing chains; no row without vectors."""
    rows = df.filter(F.col(vec).isNotNull()).select(F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    total = rows.groupBy(F.lit(0).alias("_all")).agg(_vector_sum(F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return total.select(F.transform("_s", lambda x: x / F.col("_n")).alias(f"mean_{vec}"))


def concat_branches(df: DataFrame, branches: Sequence[str] = ("hc", "lc", "ag"), out: str = "features") -> DataFrame:
    """Concatenated branch vectors with presence flags (H4).

    A missing branch takes the mean vector of the present ones.
    """
    from ..functions.ordering import attach_row

    rows = df
    for b in branches:
        rows = attach_row(rows, mean_vector(df, b))
    parts = [F.coalesce(F.col(b).cast("array<double>"), F.col(f"mean_{b}"), F.array().cast("array<double>")) for b in branches]
    flags = {f"{b}_present": F.col(b).isNotNull() for b in branches}
    return rows.withColumns(flags).withColumn(out, F.concat(*parts)).drop(*[f"mean_{b}" for b in branches])


def fold_scaler(rows: DataFrame, label: str, split: str = "split", fold: str = "fold") -> DataFrame:
    """Mean and population deviation of the training label per fold; zero deviation becomes 1."""
    train = rows.filter(F.col(split) == "train")
    std = F.when(F.min(label) == F.max(label), 1.0).otherwise(F.stddev_pop(label))
    return train.groupBy(fold).agg(F.avg(label).alias("label_mean"), std.alias("label_std"))


def scale_by_fold(rows: DataFrame, label: str, out: str = "scaled", split: str = "split", fold: str = "fold") -> DataFrame:
    """Standardise every split with the training moments of its fold (H5).

    The scaler has one row per fold, so it is broadcast and the rows stay where they are.
    """
    scaled = rows.join(F.broadcast(fold_scaler(rows, label, split, fold)), fold)
    return scaled.withColumn(out, (F.col(label) - F.col("label_mean")) / F.col("label_std"))


def unscale(value: Column, mean: str = "label_mean", std: str = "label_std") -> Column:
    return value * F.col(std) + F.col(mean)


def residuals(df: DataFrame, truth: str, pred: str, out: str = "residual") -> DataFrame:
    """Prediction minus truth (H8)."""
    return df.withColumn(out, F.col(pred) - F.col(truth))


class Moments:
    """Count, mean and centered products of rows ``(features, label)``; two of them merge exactly."""

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, rows: np.ndarray) -> "Moments":
        mean = rows.mean(0)
        apart = rows - mean
        return cls(float(len(rows)), mean, apart.T @ apart)

    def merged(self, other: "Moments", sign: int = 1) -> "Moments":
        """Both sets of rows together, or with ``sign=-1`` these rows without the other ones."""
        n = self.n + sign * other.n
        if n <= 0:
            return Moments(0.0, self.mean * 0, self.products * 0)
        gap = other.mean - self.mean
        return Moments(n, self.mean + sign * gap * (other.n / n), self.products + sign * (other.products + np.outer(gap, gap) * (self.n * other.n / n)))

    def line(self, reg_param: float) -> tuple[np.ndarray, float]:
        """Weights and intercept of the ridge regression of the last column on the others.

        Features and label are scaled to deviation 1 for the penalty
        ``reg_param / 2 |weights|^2`` beside half the mean squared error; a feature that
        doesn't vary gets weight 0, and dependent features the shortest solution.
        """
        if not self.n:
            return np.full(len(self.mean) - 1, np.nan), np.nan
        cov = self.products / self.n
        scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
        flat = scale <= 1e-12 * np.abs(self.mean)
        scale[flat] = 1.0
        corr = cov / np.outer(scale, scale)
        corr[flat], corr[:, flat] = 0.0, 0.0
        gram = corr[:-1, :-1] + reg_param * np.eye(len(corr) - 1)
        beta = np.linalg.lstsq(gram, corr[:-1, -1], rcond=1e-10)[0] / scale[:-1] * scale[-1]
        return beta, float(self.mean[-1] - self.mean[:-1] @ beta)


MOMENTS = "fold int, n double, mean array<double>, products array<double>"


def _packed(fold: int, m: Moments) -> dict:
    return {"fold": fold, "n": m.n, "mean": m.mean, "products": m.products.ravel()}


def _merge_rows(rows) -> Moments:
    out = None
    for n, mean, products in zip(rows["n"], rows["mean"], rows["products"]):
        mean = np.asarray(mean, dtype=float)
        m = Moments(n, mean, np.asarray(products, dtype=float).reshape(len(mean), -1))
        out = m if out is None else out.merged(m)
    return out


def fold_moments(rows: DataFrame, folds: int) -> dict[int, Moments]:
    """Moments of all rows (key -1) and of the rows outside the training set of each fold, in one scan.

    ``rows`` holds ``x, y`` and the array ``outside`` of folds that don't train on the row.
    A task keeps one set of moments per fold; they merge in groups of about the root
    of the number of tasks, and one row per fold reaches the driver.
    """
    import pandas as pd

    def collect(batches):
        kept: dict[int, Moments] = {}
        for b in batches:
            if not len(b):
                continue
            z = np.column_stack([np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(dtype=float)])
            at = b["outside"].to_numpy()
            place, fold = np.repeat(np.arange(len(b)), [len(o) for o in at]), np.concatenate([np.asarray(o, dtype=int) for o in at])
            for f in (-1, *np.unique(fold).tolist()):
                m = Moments.of(z if f < 0 else z[place[fold == f]])
                kept[f] = kept[f].merged(m) if f in kept else m
        if kept:
            yield pd.DataFrame([_packed(f, m) for f, m in kept.items()])

    def merge(part):
        return pd.DataFrame([_packed(part["fold"].iloc[0], _merge_rows(part))])

    parts = rows.select("x", "y", "outside").mapInPandas(collect, MOMENTS)
    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    some = parts.withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(fan))).groupBy("fold", "_fan").applyInPandas(merge, MOMENTS)
    got = some.groupBy("fold").applyInPandas(merge, MOMENTS).toPandas()
    return {int(f): _merge_rows(got[got["fold"] == f]) for f in got["fold"]}


def cross_validate(
    df: DataFrame, splits: DataFrame, features: str, label: str, row_idx: str = "row_idx", reg_param: float = 0.0, max_width: int = 1024,
) -> DataFrame:
    """Test predictions of a linear regression per fold on the scaled label (H6).

    A linear model stands in for a neural head. Returns ``fold, row_idx, truth,
    pred``; metrics come from the metric operators. One scan collects the moments
    of all rows and of each fold's held-out rows; the training moments are their
    difference, from which all folds are solved at once, however many there are.
    Features wider than ``max_width`` (whose products would not fit a task) are
    fitted fold by fold with an iterative solver of the same objective. Rows
    without label or features train nothing; a test row without features, or of a
    fold without training rows, has no prediction.
    """
    import pandas as pd

    named = splits.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("fold").cast("int").alias("fold"), "split")
    folds = [r["fold"] for r in named.select("fold").distinct().orderBy("fold").collect()]
    if not folds:
        raise ValueError("the split has no folds")
    of = lambda s: F.collect_set(F.when(F.col("split") == s, F.col("fold")))
    places = named.groupBy("row_idx").agg(of("train").alias("_train"), of("test").alias("test"))
    places = places.select("row_idx", "test", F.array_except(F.array(*[F.lit(f) for f in folds]), "_train").alias("outside"))
    values = df.select(F.col(row_idx).cast("long").alias("row_idx"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    # Read by the fit and by the predictions, so the joined rows are written once.
    checkpoint_dir(df.sparkSession)
    rows = values.join(places, "row_idx").checkpoint()
    usable = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    width = usable.agg(F.max(F.size("x"))).first()[0]
    if width is not None and width > max_width:
        return _fitted_by_fold(rows, usable, folds, reg_param)
    moments = fold_moments(usable, len(folds)) if width is not None else {}
    every = moments.get(-1)
    lines = {}
    for f in folds:
        out = moments.get(f)
        lines[f] = None if every is None else (every if out is None else every.merged(out, -1)).line(reg_param)

    def predict(batches):
        for b in batches:
            x, test = b["x"].to_numpy(), b["test"].to_numpy()
            cells = [(f, i) for i, t in enumerate(test) for f in t]
            pred = [np.nan if x[i] is None or lines[f] is None else float(np.asarray(x[i], dtype=float) @ lines[f][0] + lines[f][1]) for f, i in cells]
            at = [i for _, i in cells]
            yield pd.DataFrame({"fold": [f for f, _ in cells], "row_idx": b["row_idx"].to_numpy()[at] if at else [], "truth": b["y"].to_numpy()[at] if at else [], "pred": pred})

    found = rows.filter(F.size("test") > 0).mapInPandas(predict, "fold int, row_idx long, truth double, pred double")
    return found.select("fold", "row_idx", M.nan_to_null(F.col("truth")).alias("truth"), M.nan_to_null(F.col("pred")).alias("pred"))


def _fitted_by_fold(rows: DataFrame, usable: DataFrame, folds: Sequence[int], reg_param: float) -> DataFrame:
    """The wide form of :func:`cross_validate`: one iterative fit per fold."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(featuresCol="_x", labelCol="y", predictionCol="pred", solver="l-bfgs", regParam=reg_param)
    out = None
    for f in folds:
        train = usable.filter(~F.array_contains("outside", f)).withColumn("_x", array_to_vector("x"))
        scale = train.agg(F.stddev_pop("y")).first()[0]
        # The label's own scale enters the penalty there, so it is taken out before.
        fitted = model.copy({model.regParam: reg_param * (scale or 1.0)}).fit(train)
        test = fitted.transform(rows.filter(F.array_contains("test", f) & F.col("x").isNotNull()).withColumn("_x", array_to_vector("x")))
        part = test.select(F.lit(f).alias("fold"), "row_idx", F.col("y").alias("truth"), "pred")
        missing = rows.filter(F.array_contains("test", f) & F.col("x").isNull()).select(F.lit(f).alias("fold"), "row_idx", F.col("y").alias("truth"), F.lit(None).cast("double").alias("pred"))
        out = part.unionByName(missing) if out is None else out.unionByName(part).unionByName(missing)
    return out.checkpoint()


def fold_metrics(preds: DataFrame, keys: Sequence[str] = ("fold",), kd_metrics: bool = False) -> DataFrame:
    """Every regression and rank metric per fold."""
    keys = list(keys)
    out = M.regression_errors(preds, keys, "truth", "pred")
    for part in (
        M.spearman(preds, keys, "truth", "pred"), M.pearson(preds, keys, "truth", "pred"),
        M.kendall_tau(preds, keys, "truth", "pred"), M.concordance(preds, keys, "truth", "pred"),
    ):
        out = out.join(part.drop("n"), keys)
    if kd_metrics:
        kd = preds.select(*keys, F.pow(F.lit(10.0), -F.col("truth")).alias("kt"), F.pow(F.lit(10.0), -F.col("pred")).alias("kp"))
        return out.join(M.fold_error(kd, keys, "kt", "kp").drop("n"), keys)
    return out.withColumns({c: F.lit(None).cast("double") for c in ("gmfe", "p2_within", "p3_within")})


def predictions_table(preds: DataFrame, df: DataFrame, antibody: str = "Antibody", antigen: str = "Antigen", row_idx: str = "row_idx", kd_metrics: bool = True) -> DataFrame:
    """Prediction rows with names and KD values (H7); folds are numbered from 1."""
    named = preds.join(df.select(F.col(row_idx).cast("long").alias("row_idx"), F.col(antibody).alias("Antibody"), F.col(antigen).alias("Antigen")), "row_idx")
    kd = lambda c: F.pow(F.lit(10.0), -F.col(c)) if kd_metrics else F.lit(None).cast("double")
    return named.select(
        (F.col("fold") + 1).alias("Fold"), F.col("row_idx").alias("idx"), "Antibody", "Antigen",
        kd("truth").alias("KD_true"), kd("pred").alias("KD_pred"),
        F.col("truth").alias("affinity_true_label"), F.col("pred").alias("affinity_pred_label"))

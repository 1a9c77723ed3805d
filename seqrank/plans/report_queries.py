"""Feature and report queries (inventory H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as H
from ..operators import metrics as M
from ..operators import reports as I
from ..operators import splits as S
from .registry import query, rnd, rounded
from .mutation_queries import _TOKENS, _TWO
from .scoring_queries import _WSQL, TOY_WEIGHTS
from .split_queries import _SIMPLE

@query("composition_vector", "H1", f"""
SELECT doc_id, i, round(coalesce((length(s) - length(replace(s, substr('{H.ALPHABET}', i + 1, 1), ''))) / nullif(length(s), 0), 0), 6) + 0.0 AS share
FROM (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS s FROM {{documents}}), (SELECT cast(unnest(range(0, 21)) AS int) AS i)""")
def composition_vector(t):
    rows = t("documents").select("doc_id", F.posexplode(H.composition_vector("text")).alias("i", "share"))
    return rounded(rows)


# A property table from a rule: position in the alphabet and its square.
_PROPERTIES = {a: (i / 10.0, i * i / 100.0) for i, a in enumerate(H.ALPHABET)}


@query("property_vector", "H2", f"""
SELECT poi, chain, {rnd('avg(i / 10.0)', 'p0', 9)}, {rnd('avg(i * i / 100.0)', 'p1', 9)} FROM (
SELECT poi, chain, cast(instr('{H.ALPHABET}', substr(seq, pos, 1)) - 1 AS double) AS i FROM {{wt}}, {{positions}}) GROUP BY poi, chain""")
def property_vector(t):
    rows = t("wt").withColumn("c", H.composition_vector("seq")).select("poi", "chain", H.property_vector("c", _PROPERTIES).alias("p"))
    return rounded(rows.select("poi", "chain", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")), 9)


@query("pool_residues", "H3", f"""
SELECT label, d, {rnd('sum(x * m) / greatest(sum(m), 1)', 'x')} FROM (
SELECT label, cast(vec_id % 2 AS double) AS m, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS d FROM {{embeddings}}) GROUP BY label, d""")
def pool_residues(t):
    rows = t("embeddings").select("label", "embedding", (F.col("vec_id") % 2).alias("m"))
    out = H.pool_residues(rows, "label", "mean", "embedding", "m")
    return rounded(out.select("label", F.posexplode("embedding").alias("d", "x")).withColumn("d", F.col("d").cast("long")))


_BRANCH = "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding END AS hc, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE embedding END AS lc, embedding AS ag FROM {embeddings}"


@query("concat_branches", "H4", f"""
SELECT vec_id, hc IS NOT NULL AS hc_present, lc IS NOT NULL AS lc_present,
       round(coalesce(hc[1]::double, (SELECT avg(hc[1]::double) FROM b)), 6) + 0.0 AS f0, round(coalesce(lc[64]::double, (SELECT avg(lc[64]::double) FROM b)), 6) + 0.0 AS f127, 192 AS width FROM b""",
       {"b": _BRANCH})
def concat_branches(t):
    out = H.concat_branches(t.sql(_BRANCH))
    return rounded(out.select("vec_id", "hc_present", "lc_present", F.col("features")[0].alias("f0"), F.col("features")[127].alias("f127"), F.size("features").alias("width")))


@query("scale_by_fold", "H5", """
SELECT fold, row_idx, round((affinity - m) / s, 6) + 0.0 AS scaled, round((affinity - m) / s * s + m, 4) + 0.0 AS back FROM sp JOIN {clustered} USING (row_idx)
JOIN (SELECT fold, avg(affinity) AS m, stddev_pop(affinity) AS s FROM sp JOIN {clustered} USING (row_idx) WHERE split = 'train' GROUP BY fold) USING (fold)""", {"sp": _SIMPLE})
def scale_by_fold(t):
    rows = t.sql(_SIMPLE).join(t("clustered").select("row_idx", "affinity"), "row_idx")
    out = H.scale_by_fold(rows, "affinity")
    back = F.round(H.unscale(F.col("scaled")), 4) + 0.0
    return rounded(out.select("fold", "row_idx", "scaled", back.alias("back")))


def _regression(t):
    rows = t("embeddings").select("vec_id", "embedding", (F.col("label") + F.col("embedding")[0] * 3).cast("double").alias("y"))
    splits = S.repeated_random_folds(rows, 3, 0.1, 0.2, 42, "vec_id")
    return H.cross_validate(rows, splits, "embedding", "y", "vec_id")


_LINE = "SELECT o_orderkey AS row_idx, o_totalprice / 1e4 AS y, o_custkey / 1e3 AS x FROM {orders}"


@query("cross_validate_line", "H6", f"""
SELECT fold, row_idx, {rnd('a * x + b', 'pred', 4)} FROM (SELECT cast(row_idx % 3 AS int) AS fold, row_idx, x FROM line) JOIN fit USING (fold)""", {
    "line": _LINE,
    "fit": """SELECT fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM line JOIN (SELECT cast(unnest(range(0, 3)) AS int) AS fold) k ON row_idx % 3 <> fold GROUP BY fold"""})
def cross_validate_line(t):
    """One feature, so that the fit has a closed form."""
    rows = t.sql(_LINE).withColumn("v", F.array("x"))
    splits = rows.select("row_idx", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold")).withColumn(
        "split", F.when(F.col("row_idx") % 3 == F.col("fold"), "test").otherwise("train"))
    return rounded(H.cross_validate(rows, splits, "v", "y", "row_idx").select("fold", "row_idx", "pred"), 4)


_PLANE = "SELECT o_orderkey AS row_idx, o_totalprice / 1e4 AS y, o_custkey / 1e3 AS x, (o_orderkey * 7919 % 1009) / 1e2 AS z FROM {orders}"


@query("cross_validate_plane", "H6 E10 E11", f"""
SELECT fold, count(*) AS n, {rnd('avg(pow(p - y, 2))', 'mse', 4)}, {rnd('sqrt(avg(pow(p - y, 2)))', 'rmse', 4)}, {rnd('avg(abs(p - y))', 'mae', 4)},
       {rnd('1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*))', 'r2', 4)}
FROM (SELECT fold, y, my + a * (x - mx) + b * (z - mz) AS p FROM (SELECT *, cast(row_idx % 5 AS int) AS fold FROM plane) JOIN fit USING (fold)) GROUP BY fold""", {
    "plane": _PLANE,
    "fit": """SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM (
        SELECT fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
        FROM plane JOIN (SELECT cast(unnest(range(0, 5)) AS int) AS fold) k ON row_idx % 5 <> fold GROUP BY fold)"""})
def cross_validate_plane(t):
    """Two features: the twin solves the normal equations of each fold."""
    rows = t.sql(_PLANE).withColumn("v", F.array("x", "z"))
    splits = rows.select("row_idx", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("fold")).withColumn(
        "split", F.when(F.col("row_idx") % 5 == F.col("fold"), "test").otherwise("train"))
    return rounded(M.regression_errors(H.cross_validate(rows, splits, "v", "y", "row_idx"), ["fold"], "truth", "pred"), 4)


@query("cross_validate", "H6")
def cross_validate(t):
    return rounded(H.fold_metrics(_regression(t)))


@query("predictions_table", "H7", f"""
SELECT cast(o_orderkey % 3 + 1 AS int) AS "Fold", o_orderkey AS idx, o_orderstatus AS "Antibody", o_orderpriority AS "Antigen",
       {rnd('pow(10, -o_totalprice / 1e5)', '"KD_true"', 9)}, {rnd('pow(10, -o_totalprice / 2e5)', '"KD_pred"', 9)}, {rnd('o_totalprice / 1e5', 'affinity_true_label', 9)}, {rnd('o_totalprice / 2e5', 'affinity_pred_label', 9)} FROM {{orders}}""")
def predictions_table(t):
    o = t("orders")
    preds = o.select((F.col("o_orderkey") % 3).cast("int").alias("fold"), F.col("o_orderkey").alias("row_idx"), (F.col("o_totalprice") / 1e5).alias("truth"), (F.col("o_totalprice") / 2e5).alias("pred"))
    return rounded(H.predictions_table(preds, o.withColumn("row_idx", F.col("o_orderkey")), "o_orderstatus", "o_orderpriority"), 9)


@query("residuals", "H8", f"SELECT l_orderkey, l_linenumber, fold, {rnd('pred - truth', 'residual')} FROM {{folds}}")
def residuals(t):
    return rounded(H.residuals(t("folds"), "truth", "pred").select("l_orderkey", "l_linenumber", "fold", "residual"))


# ---------------------------------------------------------------- leaderboards

_OLD = """SELECT concat('m', cast(l_suppkey % 7 AS string)) AS Model, concat('n', cast(l_suppkey % 2 AS string)) AS Net, CASE WHEN l_linenumber = 7 THEN 'bad' ELSE cast(l_linenumber AS string) END AS Fold,
 avg(l_discount) AS Spearman, 'old' AS RunTag FROM {lineitem} GROUP BY 1, 2, 3"""
_NEW = """SELECT concat('m', cast(l_suppkey % 3 AS string)) AS Model, concat('n', cast(l_suppkey % 2 AS string)) AS Net, cast(l_linenumber AS string) AS Fold,
 avg(l_tax) AS Spearman, 'new' AS RunTag FROM {lineitem} WHERE l_linenumber < 5 GROUP BY 1, 2, 3"""
_UPS = {"old": f"SELECT * REPLACE (coalesce(try_cast(Fold AS int), 0) AS Fold) FROM ({_OLD})", "new": f"SELECT * REPLACE (coalesce(try_cast(Fold AS int), 0) AS Fold) FROM ({_NEW})",
        "ups": "SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (Model, Net, Fold)"}


@query("upsert_summary", "I1", f'SELECT Model AS "Model", Net AS "Net", Fold AS "Fold", {rnd("Spearman", chr(34) + "Spearman" + chr(34))}, RunTag AS "RunTag" FROM ups', _UPS)
def upsert_summary(t):
    return rounded(I.upsert_summary(t.sql(_OLD), t.sql(_NEW)))


@query("replace_model", "I2", f"""
SELECT Model AS "Model", Net AS "Net", Fold AS "Fold", {rnd("Spearman", chr(34) + "Spearman" + chr(34))}, RunTag AS "RunTag" FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (Model))""",
       {k: _UPS[k] for k in ("old", "new")})
def replace_model(t):
    return rounded(I.replace_model(t.sql(_OLD), t.sql(_NEW)))


@query("rank_models", "I3", f'SELECT Model AS "Model", Net AS "Net", {rnd("avg(Spearman)", chr(34) + "Spearman_mean" + chr(34))} FROM ups GROUP BY Model, Net', _UPS)
def rank_models(t):
    return rounded(I.rank_models(I.upsert_summary(t.sql(_OLD), t.sql(_NEW))))


@query("upsert_ranking", "I4", f"""
SELECT Model AS "Model", Net AS "Net", round(coalesce(b.s, a.s), 6) + 0.0 AS "Spearman_mean" FROM (SELECT Model, Net, avg(Spearman) AS s FROM old GROUP BY ALL) a
FULL JOIN (SELECT Model, Net, avg(Spearman) AS s FROM new GROUP BY ALL) b USING (Model, Net)""", {k: _UPS[k] for k in ("old", "new")})
def upsert_ranking(t):
    return rounded(I.upsert_ranking(I.rank_models(t.sql(_OLD)), I.rank_models(t.sql(_NEW))))


# ---------------------------------------------------------------- distributions

@query("label_summary", "I5", f"""
SELECT fold, count(*) AS n, {rnd('avg(v)', 'mean')}, {rnd('stddev_pop(v)', 'std')}, {rnd('min(v)', 'min')}, {rnd('quantile_cont(v, 0.25)', 'q25')}, {rnd('median(v)', 'median')},
       {rnd('quantile_cont(v, 0.75)', 'q75')}, {rnd('max(v)', 'max')}, {rnd('avg(z * z * z)', 'skew', 5)}, {rnd('avg(z * z * z * z) - 3', 'kurtosis', 5)}
FROM (SELECT fold, truth AS v, (truth - avg(truth) OVER (PARTITION BY fold)) / stddev_pop(truth) OVER (PARTITION BY fold) AS z FROM {{folds}}) GROUP BY fold""")
def label_summary(t):
    out = I.label_summary(t("folds"), "truth", "fold")
    return rounded(out.withColumns({c: F.round(c, 5) for c in ("skew", "kurtosis")}))


@query("ecdf", "I6", f"""
SELECT DISTINCT status, affinity, cast(count(*) OVER (PARTITION BY status, affinity) AS bigint) AS n, round(cume_dist() OVER (PARTITION BY status ORDER BY affinity), 9) + 0.0 AS share FROM {{clustered}}""")
def ecdf(t):
    return rounded(I.ecdf(t("clustered"), "affinity", ["status"]), 9)


@query("ecdf_rows", "I6", f"""
SELECT status, row_idx, affinity, round(row_number() OVER (PARTITION BY status ORDER BY affinity, row_idx) / count(*) OVER (PARTITION BY status), 9) + 0.0 AS share FROM {{clustered}}""")
def ecdf_rows(t):
    return rounded(I.ecdf_rows(t("clustered"), "affinity", "row_idx", ["status"]), 9)


@query("histogram", "I7", f"""
SELECT status, bin, {rnd('lo + bin * w', 'left_edge', 4)}, n, {rnd('n / (sum(n) OVER (PARTITION BY status) * w)', 'density', 9)} FROM (
SELECT status, cast(least(floor((affinity - lo) / w), 39) AS int) AS bin, count(*) AS n, min(lo) AS lo, min(w) AS w FROM {{clustered}},
 (SELECT min(affinity) AS lo, (max(affinity) - min(affinity)) / 40 AS w FROM {{clustered}}) GROUP BY 1, 2)""")
def histogram(t):
    out = rounded(I.histogram(t("clustered"), "affinity", 40, ["status"]), 9)
    return out.withColumn("left_edge", F.round("left_edge", 4) + 0.0)


@query("cluster_size_histogram", "I7", "SELECT size, count(*) AS clusters FROM (SELECT cluster, count(*) AS size FROM {clustered} WHERE cluster IS NOT NULL GROUP BY cluster) GROUP BY size")
def cluster_size_histogram(t):
    return I.cluster_size_histogram(t("clustered"), "cluster")


@query("dataset_manifest", "I8 A11", """
SELECT 'summary' AS kind, '{"rows":' || count(*) || ',"source_row_min":' || min(row_idx) || ',"source_row_max":' || max(row_idx) || ',"cluster_present":' || count(cluster) || ',"seed":42}' AS line FROM {clustered}
UNION ALL SELECT 'cluster', CASE WHEN cluster IS NULL THEN '{"rows":' || count(*) || '}' ELSE '{"cluster":"' || cluster || '","rows":' || count(*) || '}' END FROM {clustered} GROUP BY cluster""")
def dataset_manifest(t):
    return I.dataset_manifest(t("clustered"), "row_idx", "cluster", ["cluster"], {"seed": 42})


@query("metrics_long", "I9", """
SELECT p_partkey, 'p_size' AS metric, cast(p_size AS double) AS value FROM {part} UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM {part}""")
def metrics_long(t):
    wide = t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return I.metrics_long(wide, ["p_partkey"], ["p_size", "p_retailprice"])


@query("add_scores", "I10 D19", f"""
SELECT d.rid, d.mutant, d.seq, d.built AS mutated_sequence, d.label, round(cast(s.s AS double), 6) + 0.0::double AS mock_score FROM done d
JOIN (SELECT rid, sum({_WSQL.format('mt')} - {_WSQL.format('wt')} - 0.01 * (pos - 1)) AS s FROM parsed GROUP BY rid) s USING (rid) WHERE ok""",
       {**_TOKENS, **_TWO})
def add_scores(t):
    from ..functions.mutation_text import mutation_problem

    rows = t("heavy_mut").filter(mutation_problem("seq", "mutant").isNull())
    return rounded(I.add_scores(rows, TOY_WEIGHTS, "rid", "seq", "mutant", "label"))

"""Metric queries (inventory E, B13-B15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import fixture, query, rnd, rounded

# SQL twins rank rows directly; the Spark side works on value histograms.
_RANKED = {
    "ranked": """
SELECT *, count(*) OVER (PARTITION BY grp) AS n,
       (rank() OVER (PARTITION BY grp ORDER BY label)) + (count(*) OVER (PARTITION BY grp, label) - 1) / 2.0 AS ry,
       (rank() OVER (PARTITION BY grp ORDER BY pred)) + (count(*) OVER (PARTITION BY grp, pred) - 1) / 2.0 AS rp,
       row_number() OVER (PARTITION BY grp ORDER BY pred DESC, rid) AS place,
       row_number() OVER (PARTITION BY grp ORDER BY label DESC, rid) AS ideal_place
FROM {src}""",
    "cuts": """
SELECT grp, quantile_cont(label, 0.9) AS cy, quantile_cont(pred, 0.9) AS cp FROM {src} GROUP BY grp""",
    "flagged": """
SELECT r.*, CASE WHEN label >= cy THEN 1 ELSE 0 END AS ay, CASE WHEN pred >= cp THEN 1 ELSE 0 END AS ap,
       greatest(1, floor(n / 10)) AS k
FROM ranked r JOIN cuts USING (grp)""",
    "tied": """
SELECT grp, pred, avg(ry) AS gain, sum(CASE WHEN place <= k THEN 1 / log2(place + 1) ELSE 0 END) AS disc,
       count(*) AS m, sum(ay) AS hits
FROM flagged GROUP BY grp, pred""",
    "stepped": """
SELECT *, sum(m) OVER w AS seen, sum(hits) OVER w AS found, sum(hits) OVER (PARTITION BY grp) AS wanted
FROM tied WINDOW w AS (PARTITION BY grp ORDER BY pred DESC)""",
    "by_rank": """
SELECT grp, sum(gain * disc) AS dcg, sum((hits / wanted) * (found / seen)) AS ap FROM stepped GROUP BY grp""",
    "by_row": """
SELECT grp, count(*) AS n,
       CASE WHEN min(ry) < max(ry) AND min(rp) < max(rp) THEN corr(ry, rp) END AS spearman,
       CASE WHEN sum(ay) < count(*) THEN (sum(ay * rp) - sum(ay) * (sum(ay) + 1) / 2.0) / (sum(ay) * (count(*) - sum(ay))) END AS auc,
       CASE WHEN sum(ay) * (count(*) - sum(ay)) * sum(ap) * (count(*) - sum(ap)) > 0
            THEN (sum(ay * ap) * count(*) - sum(ay) * sum(ap)) /
                 sqrt(cast(sum(ay) as double) * (count(*) - sum(ay)) * sum(ap) * (count(*) - sum(ap))) ELSE 0 END AS mcc,
       sum(CASE WHEN ideal_place <= k THEN ry / log2(ideal_place + 1) ELSE 0 END) AS ideal
FROM flagged GROUP BY grp""",
}


def _ranking_sql(src: str) -> dict[str, str]:
    return {k: v.replace("{src}", "{" + src + "}") for k, v in _RANKED.items()}


_RANKING_SELECT = (
    f"SELECT grp, n, {rnd('spearman', 'spearman')}, {rnd('auc', 'auc')}, {rnd('mcc', 'mcc')}, "
    f"{rnd('dcg / ideal', 'ndcg')}, {rnd('ap', 'ap')} FROM by_row JOIN by_rank USING (grp)"
)


@query("ranking_metrics", "E1 E3 E4 E5 E6 B14", _RANKING_SELECT, _ranking_sql("scored"))
def ranking_metrics(t):
    return rounded(M.ranking_metrics(M.numeric_pairs(t("scored"), "label", "pred"), ["grp"], "label", "pred"))


@query("ranking_metrics_events", "E1 E3 E4 E5 E6 E9", _RANKING_SELECT, _ranking_sql("scored_events"))
def ranking_metrics_events(t):
    return rounded(M.evaluate(t("scored_events"), ["grp"], "label", "pred"))


# Two predicted values over all rows: tied runs beyond the summed part of the discounts.
fixture("tied_scores", "SELECT 'all' AS grp, label, cast(length(mutant) % 2 as double) AS pred, rid FROM {heavy_mut}")


@query("ranking_metrics_tied", "E1 E3 E4 E5 E6", _RANKING_SELECT, _ranking_sql("tied_scores"))
def ranking_metrics_tied(t):
    return rounded(M.ranking_metrics(t("tied_scores"), ["grp"], "label", "pred"))


@query("spearman", "E1", f"SELECT grp, n, {rnd('spearman', 'spearman')} FROM by_row",
       {k: v for k, v in _ranking_sql("scored").items() if k in ("ranked", "cuts", "flagged", "by_row")})
def spearman(t):
    return rounded(M.spearman(t("scored"), ["grp"], "label", "pred"))


@query("pearson", "E2", f"""
SELECT grp, count(*) AS n, round(CASE WHEN min(label) < max(label) AND min(pred) < max(pred) THEN corr(label, pred) END, 6) + 0.0 AS pearson
FROM {{scored}} GROUP BY grp""")
def pearson(t):
    return rounded(M.pearson(t("scored"), ["grp"], "label", "pred"))


def _hits_sql() -> tuple[str, dict[str, str]]:
    ctes = {
        "a": "SELECT grp, pred, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY label, rid) - 1 AS r FROM {scored}",
        "b": """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pred, r) - 1 AS q,
                sum(CASE WHEN r * 10 >= 9 * n THEN 1 ELSE 0 END) OVER (PARTITION BY grp) AS top,
                sum(CASE WHEN r * 10 < n THEN 1 ELSE 0 END) OVER (PARTITION BY grp) AS bottom FROM a""",
    }
    cols = []
    for k in (10, 20, 50, 100):
        th = f"avg(CASE WHEN q >= CASE WHEN top = 0 THEN 0 ELSE n - least({k}, top) END THEN CASE WHEN r >= n - top THEN 1.0 ELSE 0.0 END END)"
        bh = f"avg(CASE WHEN q >= top AND q < top + least({k}, top, bottom) THEN CASE WHEN r < bottom THEN 1.0 ELSE 0.0 END END)"
        cols += [rnd(th, f"top_hit_{k}"), rnd(bh, f"bottom_hit_{k}"), rnd(f"{th} - {bh}", f"unbias_hit_{k}")]
    return f"SELECT grp, cast(max(n) as bigint) AS n, {', '.join(cols)} FROM b GROUP BY grp", ctes


@query("top_bottom_hits", "E7", *_hits_sql())
def top_bottom_hits(t):
    return rounded(M.top_bottom_hits(t("scored"), ["grp"], "label", "pred", "rid"))


_HITS_SELECT, _HITS = _hits_sql()


@query("evaluate_hits", "E7 E9", f"SELECT m.*, h.* EXCLUDE (grp, n) FROM ({_RANKING_SELECT}) m JOIN ({_HITS_SELECT}) h USING (grp)", {**_ranking_sql("scored"), **_HITS})
def evaluate_hits(t):
    return rounded(M.evaluate(t("scored"), ["grp"], "label", "pred", hits=True, row_id="rid"))


# Three kinds of files: both score columns, only the second one, none at all.
_FILES = """
SELECT concat(grp, '.csv') AS file,
       cast(label as string) AS label_text, label,
       CASE WHEN length(grp) % 2 = 1 THEN pred END AS wt_score,
       CASE WHEN grp <> 'few_rows' THEN pred + 1 END AS masked_score
FROM {scored}"""


@query("per_file_correlation", "E8", f"""
SELECT file, round(CASE WHEN v THEN corr(label, pred) END, 6) + 0.0 AS pearson,
       round(CASE WHEN v THEN corr(ry, rp) END, 6) + 0.0 AS spearman,
       CASE WHEN count(pred) = 0 THEN 'missing' WHEN NOT v THEN 'zero variance' ELSE 'computed' END AS status
FROM (SELECT *, min(label) OVER g < max(label) OVER g AND min(pred) OVER g < max(pred) OVER g AS v FROM w WINDOW g AS (PARTITION BY file))
GROUP BY file, v""", {
    "files": _FILES,
    "c": "SELECT file, label, CASE WHEN count(wt_score) OVER (PARTITION BY file) > 0 THEN wt_score ELSE masked_score END AS pred FROM files",
    "w": """SELECT *, (rank() OVER (PARTITION BY file ORDER BY label)) + (count(*) OVER (PARTITION BY file, label) - 1) / 2.0 AS ry,
            (rank() OVER (PARTITION BY file ORDER BY pred)) + (count(*) OVER (PARTITION BY file, pred) - 1) / 2.0 AS rp FROM c""",
})
def per_file_correlation(t):
    return rounded(M.per_file_correlation(t.sql(_FILES), "file", "label"))


_FOLD = "SELECT fold, truth AS t, pred AS p FROM {folds}"


@query("regression_errors", "E10 E11", f"""
SELECT fold, count(*) AS n, {rnd('avg((p-t)*(p-t))', 'mse')}, {rnd('sqrt(avg((p-t)*(p-t)))', 'rmse')}, {rnd('avg(abs(p-t))', 'mae')},
       {rnd('1 - sum((p-t)*(p-t)) / (var_pop(t) * count(*))', 'r2')} FROM ({_FOLD}) GROUP BY fold""")
def regression_errors(t):
    return rounded(M.regression_errors(t("folds"), ["fold"], "truth", "pred"))


@query("kendall_tau", "E12", """
SELECT fold, (SELECT count(*) FROM f b WHERE b.fold = a.fold) AS n,
       round(sum(a.n * b.n * sign(a.t - b.t) * sign(a.p - b.p)) /
       sqrt(sum(CASE WHEN a.t <> b.t THEN cast(a.n * b.n as double) ELSE 0 END)) /
       sqrt(sum(CASE WHEN a.p <> b.p THEN cast(a.n * b.n as double) ELSE 0 END)), 6) + 0.0 AS kendall_tau
FROM c a JOIN c b USING (fold) GROUP BY fold""", {
    "f": "SELECT cast(l_orderkey % 5 as int) AS fold, l_quantity AS t, l_discount AS p FROM {lineitem}",
    "c": "SELECT fold, t, p, count(*) AS n FROM f GROUP BY fold, t, p",
})
def kendall_tau(t):
    rows = t("lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_quantity", "l_discount")
    return rounded(M.kendall_tau(rows, ["fold"], "l_quantity", "l_discount"))


_ACCOUNTS = "SELECT c_nationkey AS fold, c_acctbal AS t, cast(c_custkey * 7919 % 100003 AS double) AS p FROM {customer}"


@query("kendall_tau_pairs", "E12", """
SELECT a.fold, (SELECT count(*) FROM f b WHERE b.fold = a.fold) AS n, round(sum(sign(a.t - b.t) * sign(a.p - b.p)) /
       sqrt(sum(CASE WHEN a.t <> b.t THEN 1.0::double ELSE 0 END)) / sqrt(sum(CASE WHEN a.p <> b.p THEN 1.0::double ELSE 0 END)), 6) + 0.0 AS kendall_tau
FROM f a JOIN f b USING (fold) GROUP BY a.fold""", {"f": _ACCOUNTS})
def kendall_tau_pairs(t):
    """Values with hardly any tie; the twin counts all pairs of a nation."""
    return rounded(M.kendall_tau(t.sql(_ACCOUNTS), ["fold"], "t", "p"))


@query("kendall_tau_continuous", "E12", """
SELECT fold, max(n) AS n, round((max(every) - max(tt) - max(tp) + max(tb) - 2 * max(dis)) / sqrt(max(every) - max(tt)) / sqrt(max(every) - max(tp)), 6) + 0.0 AS kendall_tau
FROM (SELECT fold, sum(ones)::DOUBLE AS dis FROM bits WHERE o = 0 GROUP BY fold)
JOIN (SELECT fold, count(*) AS n, count(*) * (count(*) - 1) / 2 AS every FROM f GROUP BY fold) USING (fold)
JOIN (SELECT fold, sum(c * (c - 1) / 2) AS tt FROM (SELECT fold, count(*) AS c FROM f GROUP BY fold, t) GROUP BY fold) USING (fold)
JOIN (SELECT fold, sum(c * (c - 1) / 2) AS tp FROM (SELECT fold, count(*) AS c FROM f GROUP BY fold, p) GROUP BY fold) USING (fold)
JOIN (SELECT fold, sum(c * (c - 1) / 2) AS tb FROM (SELECT fold, count(*) AS c FROM f GROUP BY fold, t, p) GROUP BY fold) USING (fold)
GROUP BY fold""", {
    "f": "SELECT fold, truth AS t, pred AS p FROM {folds}",
    "places": "SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY t, p) - 1 AS i, row_number() OVER (PARTITION BY fold ORDER BY p, t) - 1 AS j FROM f",
    "bits": """SELECT fold, o, sum(o) OVER (PARTITION BY fold, k, h ORDER BY i) AS ones
        FROM (SELECT fold, i, k, j >> (k + 1) AS h, (j >> k) & 1 AS o FROM places, unnest(range(0, 24)) AS u(k))"""})
def kendall_tau_continuous(t):
    """Hardly any tie on either side; the twin finds the first bit at which two places differ."""
    return rounded(M.kendall_tau(t("folds"), ["fold"], "truth", "pred"))


@query("concordance", "E13", f"""
SELECT fold, count(*) AS n,
       {rnd('2 * covar_pop(t, p) / (var_pop(t) + var_pop(p) + pow(avg(t) - avg(p), 2) + 1e-12)', 'ccc')} FROM ({_FOLD}) GROUP BY fold""")
def concordance(t):
    return rounded(M.concordance(t("folds"), ["fold"], "truth", "pred"))


@query("fold_error", "E14 E15", f"""
SELECT fold, count(*) AS n, {rnd('exp(avg(abs(ln(greatest(kp, 1e-12) / greatest(kt, 1e-12)))))', 'gmfe')},
       {rnd('avg(CASE WHEN greatest(kt, kp) / greatest(least(kt, kp), 1e-12) <= 2 THEN 1.0 ELSE 0.0 END)', 'p2_within')},
       {rnd('avg(CASE WHEN greatest(kt, kp) / greatest(least(kt, kp), 1e-12) <= 3 THEN 1.0 ELSE 0.0 END)', 'p3_within')}
FROM (SELECT fold, pow(10, -t) AS kt, pow(10, -p) AS kp FROM ({_FOLD})) GROUP BY fold""")
def fold_error(t):
    rows = t("folds").select("fold", F.pow(F.lit(10.0), -F.col("truth")).alias("kt"), F.pow(F.lit(10.0), -F.col("pred")).alias("kp"))
    return rounded(M.fold_error(rows, ["fold"], "kt", "kp"))


_PER_FOLD_SQL = f"""
SELECT model, fold, avg((p-t)*(p-t)) AS mse,
       CASE WHEN count(*) > 1 AND min(t) < max(t) AND min(p) < max(p)
            THEN 2 * covar_pop(t, p) / (var_pop(t) + var_pop(p) + pow(avg(t) - avg(p), 2) + 1e-12) END AS ccc
FROM (SELECT model, fold, truth AS t, pred AS p FROM {{folds}}) GROUP BY model, fold"""


def _per_fold(t):
    keys = ["model", "fold"]
    errors = M.regression_errors(t("folds"), keys, "truth", "pred").select(*keys, "mse")
    return errors.join(M.concordance(t("folds"), keys, "truth", "pred").drop("n"), keys)


@query("fold_mean", "E16", f"SELECT model, {rnd('avg(mse)', 'mse')}, {rnd('avg(ccc)', 'ccc')} FROM m GROUP BY model", {"m": _PER_FOLD_SQL})
def fold_mean(t):
    return rounded(M.fold_mean(_per_fold(t), ["model"], ["mse", "ccc"]))


@query("macro_average", "E17", f"""
SELECT model, fold, count(*) AS files, {rnd('avg(mse)', 'mse')}, {rnd('avg(ccc)', 'ccc')} FROM m GROUP BY ROLLUP (model, fold)""",
       {"m": _PER_FOLD_SQL})
def macro_average(t):
    return rounded(M.macro_average(_per_fold(t), ["model", "fold"], ["mse", "ccc"], subtotals=True))

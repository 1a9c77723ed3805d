"""Scoring queries (inventory D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mutation_text import parse_mutations
from ..operators import metrics as M
from ..operators import mutations as MU
from ..operators import scoring as S
from ..session import written
from .metric_queries import _RANKING_SELECT, _ranking_sql
from .mutation_queries import _CHAINS, _TOKENS
from .registry import query, rnd, rounded, task_count

_LP = {
    "lp": """SELECT poi, pos, aa, logit - max(logit) OVER w - ln(sum(exp(logit)) OVER w / exp(max(logit) OVER w)) AS logprob
             FROM {logits} WINDOW w AS (PARTITION BY poi, pos)""",
    "lp15": """SELECT poi, pos, aa, logit / 1.5 - ln(sum(exp(logit / 1.5)) OVER (PARTITION BY poi, pos)) AS logprob FROM {logits}""",
}


@query("log_softmax", "D6", f"SELECT poi, pos, {rnd('min(logprob)', 'lowest')}, {rnd('max(logprob)', 'highest')}, {rnd('sum(exp(logprob))', 'mass')} FROM lp GROUP BY poi, pos", _LP)
def log_softmax(t):
    out = S.log_softmax(t("logits"), ["poi", "pos"]).groupBy("poi", "pos")
    return rounded(out.agg(F.min("logprob").alias("lowest"), F.max("logprob").alias("highest"), F.sum(F.exp("logprob")).alias("mass")))


_D1 = {**_TOKENS, **_LP, "site": """SELECT p.rid, m.logprob - w.logprob AS d FROM parsed p JOIN {heavy_mut} h USING (rid)
       JOIN lp m ON m.poi = h.poi AND m.pos = p.pos AND m.aa = p.mt JOIN lp w ON w.poi = h.poi AND w.pos = p.pos AND w.aa = p.wt"""}


@query("score_delta_logprob", "D1", f"SELECT h.rid, {rnd('coalesce(sum(d), 0)', 'score')} FROM {{heavy_mut}} h LEFT JOIN site USING (rid) GROUP BY h.rid", _D1)
def score_delta_logprob(t):
    lp = S.log_softmax(t("logits"), ["poi", "pos"])
    return rounded(S.score_delta_logprob(t("heavy_mut"), lp, "rid", "poi", seq="seq"))


# The whole way from a mutation table and model outputs to metrics per assay.
_SCORED = f"SELECT substr(h.poi, 1, 2) AS grp, min(h.label) AS label, {rnd('coalesce(sum(d), 0)', 'pred')}, h.rid FROM {{heavy_mut}} h LEFT JOIN site USING (rid) GROUP BY h.rid, h.poi"


@query("score_and_evaluate", "D1 D6 E9", _RANKING_SELECT, {**_D1, "sc": _SCORED, **_ranking_sql("sc")})
def score_and_evaluate(t):
    muts = t("heavy_mut")
    scores = rounded(S.score_delta_logprob(muts, S.log_softmax(t("logits"), ["poi", "pos"]), "rid", "poi", seq="seq"))
    rows = muts.select("rid", F.substring("poi", 1, 2).alias("grp"), "label").join(scores, "rid")
    return rounded(M.evaluate(rows, ["grp"], "label", "score"))


@query("score_temperature", "D4", "SELECT h.rid, round(coalesce(sum(d), 0), 5) + 0.0 AS score FROM {heavy_mut} h LEFT JOIN s4 USING (rid) GROUP BY h.rid",
       {**_TOKENS, **_LP, "s4": """SELECT p.rid, m.logprob - w.logprob AS d FROM parsed p JOIN {heavy_mut} h USING (rid)
        JOIN lp m ON m.poi = h.poi AND m.pos = p.pos AND m.aa = p.mt JOIN lp15 w ON w.poi = h.poi AND w.pos = p.pos AND w.aa = p.wt"""})
def score_temperature(t):
    return rounded(S.score_temperature(t("heavy_mut"), t("logits"), "rid", "poi").select("rid", "score"), 5)


# Paired chains: heavy and light of one part on a table of both, light after one separator.
_PAIRED = """
SELECT rid, poi, label, seq AS heavy, translate(md5(concat('L|', substr(poi, 2))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS light,
       mutant AS mut_heavy, CASE WHEN label > 50000 THEN concat(substr(translate(md5(concat('L|', substr(poi, 2))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 3, 1), '3W')
       WHEN label > 49000 THEN 'T3W' ELSE '' END AS mut_light FROM {heavy_mut}"""
_PAIRED_LP = "SELECT poi, pos, aa, logit AS logprob FROM {logits} UNION ALL SELECT poi, 33 + pos AS pos, aa, logit * 0.5E0 AS logprob FROM {logits}"


@query("score_paired", "D2", f"""
SELECT p.rid, round(CASE WHEN mut_light = 'T3W' THEN NULL ELSE coalesce(h.s, 0) + coalesce(m.logprob - w.logprob, 0) END, 6) + 0.0 AS score
FROM pr p LEFT JOIN hs h USING (rid)
LEFT JOIN plp m ON m.poi = p.poi AND m.pos = 36 AND m.aa = right(mut_light, 1) LEFT JOIN plp w ON w.poi = p.poi AND w.pos = 36 AND w.aa = left(mut_light, 1)""", {
    **_TOKENS, "pr": _PAIRED, "plp": _PAIRED_LP,
    "hs": """SELECT t.rid, sum(m.logprob - w.logprob) AS s FROM parsed t JOIN pr USING (rid) JOIN plp m ON m.poi = pr.poi AND m.pos = t.pos AND m.aa = t.mt
             JOIN plp w ON w.poi = pr.poi AND w.pos = t.pos AND w.aa = t.wt WHERE t.pos BETWEEN 1 AND 32 GROUP BY t.rid"""})
def score_paired(t):
    return rounded(S.score_paired(t.sql(_PAIRED), t.sql(_PAIRED_LP), "rid", "poi", "mut_heavy", "mut_light", "heavy", "light"))


_CHAIN_LP = """SELECT poi, chain, pos, aa, logit - ln(sum(exp(logit)) OVER (PARTITION BY poi, chain, pos)) AS logprob FROM {chain_logits}"""


@query("score_per_chain", "D3", f"""
SELECT r.rid, CASE WHEN count(s.rid) = 0 OR count(k.poi) > 0 THEN {rnd('coalesce(sum(m.logprob - w.logprob), 0)', 'x').removesuffix(' AS x')} END AS score FROM rows_ r
LEFT JOIN (SELECT DISTINCT poi FROM clp) k ON k.poi = r.poi
LEFT JOIN (SELECT rid, poi, c, CASE c WHEN 'H' THEN mh WHEN 'L' THEN ml ELSE ma END AS tk FROM rows_ JOIN off USING (poi)
           UNION ALL SELECT rid, poi, c, left(mutant, 1) || (cast(substr(mutant, 2, length(mutant) - 2) AS int) - d) || right(mutant, 1) FROM rows_ JOIN off USING (poi)
           WHERE gstr AND cast(substr(mutant, 2, length(mutant) - 2) AS int) - d BETWEEN 1 AND 32) s ON s.rid = r.rid AND length(tk) > 2 AND tk <> 'nan'
LEFT JOIN clp m ON m.poi = r.poi AND m.chain = s.c AND m.aa = right(tk, 1) AND m.pos = cast(substr(tk, 2, length(tk) - 2) AS int)
LEFT JOIN clp w ON w.poi = r.poi AND w.chain = s.c AND w.aa = left(tk, 1) AND w.pos = cast(substr(tk, 2, length(tk) - 2) AS int)
GROUP BY r.rid""", {**_CHAINS, "clp": _CHAIN_LP})
def score_per_chain(t):
    lp = S.log_softmax(t("chain_logits"), ["poi", "chain", "pos"]).select("poi", "chain", "pos", "aa", "logprob")
    assay = t("assay")
    chains = written(MU.concat_chains(assay, "rid", "poi"))
    rows = MU.globalize_mutations(assay, "rid", "poi", table=chains)
    return rounded(S.score_per_chain(rows, lp, chains, "rid", "poi"))


@query("score_embedding_shift", "D5", f"""
SELECT a.vec_id, {rnd('-(SELECT avg(pow(x - y, 2)) FROM (SELECT unnest(a.embedding)::double AS x, unnest(b.embedding)::double AS y))', 'score')}
FROM {{embeddings}} a JOIN {{embeddings}} b ON b.vec_id = a.vec_id - a.vec_id % 10""")
def score_embedding_shift(t):
    rows = t("embeddings").select("vec_id", "embedding", (F.col("vec_id") - F.col("vec_id") % 10).alias("base"))
    wt = t("embeddings").select(F.col("vec_id").alias("base"), "embedding")
    return rounded(S.score_embedding_shift(wt, rows, ["base"], "embedding").select("vec_id", "score"))


@query("score_embedding_shift_by_label", "D5", f"""
SELECT label, {rnd('avg(s)', 'score')} FROM (SELECT a.label, -(SELECT avg(pow(x - y, 2)) FROM (SELECT unnest(a.embedding)::double AS x, unnest(b.embedding)::double AS y)) AS s
FROM {{embeddings}} a JOIN {{embeddings}} b ON b.vec_id = a.vec_id - a.vec_id % 10) GROUP BY label""")
def score_embedding_shift_by_label(t):
    rows = t("embeddings").select("label", "embedding", (F.col("vec_id") - F.col("vec_id") % 10).alias("base"))
    wt = t("embeddings").select(F.col("vec_id").alias("base"), "embedding")
    return rounded(S.score_embedding_shift(wt, rows, ["base"], "embedding", ["label"]))


@query("plan_windows_overlap", "D7", """
SELECT doc_id, kind, win_start, win_end FROM (
  SELECT doc_id, 'whole' AS kind, 0::bigint AS win_start, t - 1 AS win_end FROM d WHERE t <= 1024
  UNION ALL SELECT doc_id, 'left', l, l + 1023 FROM s UNION ALL SELECT doc_id, 'right', r, r + 1023 FROM s
  UNION ALL SELECT doc_id, 'center', greatest(0, t // 2 - 512), least(t - 1, greatest(0, t // 2 - 512) + 1023) FROM s WHERE l + 1023 > r AND l + 1023 - r + 1 < 511)""", {
    "d": "SELECT doc_id, length(text) + 2 AS t FROM {documents}",
    "s": """SELECT doc_id, t, 0::bigint AS l, t - 1024 AS r FROM d WHERE t > 1024
            UNION ALL SELECT doc_id, t, l + 511, r - 511 FROM s WHERE l + 1023 <= r"""})
def plan_windows_overlap(t):
    docs = t("documents").select("doc_id", (F.length("text") + 2).alias("t"))
    return S.plan_windows_overlap(docs, "t", 1024).select("doc_id", "kind", "win_start", "win_end")


@query("plan_windows_masked", "D8", """
SELECT poi, chain, token, CASE WHEN 34 <= 20 THEN 0 WHEN token < 10 THEN 0 WHEN token >= 24 THEN 14 ELSE token - 10 END AS win_start,
       token - CASE WHEN token < 10 THEN 0 WHEN token >= 24 THEN 14 ELSE token - 10 END AS masked_at
FROM {wt}, (SELECT cast(unnest(range(1, 33)) AS int) AS token)""")
def plan_windows_masked(t):
    rows = t("wt").select("poi", "chain", (F.length("seq") + 2).alias("t"))
    return S.plan_windows_masked(rows, "t", 20).select("poi", "chain", "token", "win_start", "masked_at")


_WIN = """SELECT s_suppkey, cast(w * 400 AS int) AS win_start, i AS offset, 1424 AS length, 'A' AS aa, ((s_suppkey * 7 + w * 3 + i) % 101) / 100E0 AS logprob
FROM {supplier} CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 1) ws CROSS JOIN (SELECT cast(p1.pos - 1 + 32 * (p2.pos - 1) AS int) AS i FROM {positions} p1 CROSS JOIN {positions} p2) ix"""
_WEIGHT = "CASE WHEN i >= 766 AND i <= 1022 THEN 1 / (1 + exp((i - 1022 + 128) / 16.0)) WHEN i >= 1 AND i <= 256 THEN 1 / (1 + exp(-(i - 128) / 16.0)) ELSE 1.0 END"


@query("blend_windows", "D9 D10", f"""
SELECT s_suppkey, pos, aa, {rnd('sum(logprob * w) / greatest(sum(w), 1e-6)', 'logprob')}
FROM (SELECT s_suppkey, win_start + i AS pos, aa, logprob, {_WEIGHT} AS w FROM (SELECT *, "offset" AS i FROM ({_WIN.replace('AS offset', 'AS "offset"')})))
WHERE pos >= 1 AND pos < 1423 GROUP BY s_suppkey, pos, aa""")
def blend_windows(t):
    # A supplier becomes two windows of 1 024 rows.
    supplier = t("supplier")
    rows = t.sql(_WIN, supplier=supplier.repartition(task_count(supplier, 2048), "s_suppkey"))
    return rounded(S.blend_windows(rows, ["s_suppkey"], 1024))


@query("window_weights", "D9", f"SELECT i, {rnd(_WEIGHT, 'weight', 9)} FROM (SELECT DISTINCT cast(p_partkey % 1024 AS int) AS i FROM {{part}})")
def window_weights(t):
    rows = t.sql("SELECT DISTINCT cast(p_partkey % 1024 AS int) AS i FROM {part}")
    return rounded(rows.select("i", S.window_weight("i", 1024).alias("weight")), 9)


@query("chunk_sequences", "D11", """
SELECT doc_id, cast(c AS int) AS chunk, md5(substr(text, cast(c AS int) * 500 + 1, 500)) AS chunk_md5
FROM (SELECT doc_id, text, unnest(range(0, cast(floor((greatest(length(text), 1) - 1) / 500) AS int) + 1)) AS c FROM {documents})""")
def chunk_sequences(t):
    out = S.chunk_sequences(t("documents").select("doc_id", "text"), "text", 500)
    return out.select("doc_id", "chunk", F.md5("chunk_text").alias("chunk_md5"))


_TOKEN_LP = """SELECT l_orderkey, l_linenumber % 2 AS chunk, CASE WHEN l_suppkey % 2 = 0 THEN 'forward' ELSE 'reverse' END AS direction,
 -l_discount * 10 - l_quantity / 50 AS logprob, l_returnflag <> 'R' AS is_residue, 7 AS len FROM {lineitem}"""


@query("sequence_loglik", "D12", f"""
SELECT l_orderkey, {rnd('sum(m) / 2', 'sum_score')}, {rnd('sum(m) / 2 / 7', 'per_residue')}, {rnd('avg(m)', 'mean_score')}, {rnd('sum(s) / 2', 'total')}, {rnd('sum(s)', 'forward_total')}
FROM (SELECT l_orderkey, avg(logprob) AS m, sum(logprob) AS s FROM ({_TOKEN_LP}) WHERE is_residue GROUP BY l_orderkey, chunk, direction) GROUP BY l_orderkey""")
def sequence_loglik(t):
    out = S.sequence_loglik(t.sql(_TOKEN_LP), "l_orderkey", ("sum", "per_residue", "mean", "total", "forward_total"), "len")
    return rounded(out.withColumnsRenamed({"sum": "sum_score", "mean": "mean_score"}))


@query("delta_vs_wildtype", "D13", f"SELECT o_orderkey, {rnd('o_totalprice - w', 'delta')} FROM {{orders}} LEFT JOIN (SELECT c_custkey AS o_custkey, c_acctbal AS w FROM {{customer}}) USING (o_custkey)")
def delta_vs_wildtype(t):
    wt = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("score"))
    rows = t("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"))
    return rounded(S.delta_vs_wildtype(rows, wt, "o_custkey").select("o_orderkey", "delta"))


def _chain_key(df):
    return df.withColumn("key", F.concat("poi", F.lit("/"), "chain"))


@query("pseudo_loglik", "D14", f"SELECT concat(w.poi, '/', w.chain) AS key, {rnd('avg(logprob)', 'pll')} FROM {{wt}} w JOIN clp lp ON lp.poi = w.poi AND lp.chain = w.chain AND lp.aa = substr(seq, lp.pos, 1) GROUP BY ALL", {"clp": _CHAIN_LP})
def pseudo_loglik(t):
    """All chains of every wild type."""
    lp = S.log_softmax(t.model_outputs("chain_logits", "key", whole=True), ["key", "pos"])
    return rounded(S.pseudo_loglik(lp, _chain_key(t("wt")), "key", "seq"))


@query("residue_probability", "D15", f"SELECT poi, aa, {rnd('avg(exp(logprob))', 'probability')}, {rnd('max(exp(logprob))', 'peak')} FROM lp GROUP BY poi, aa", _LP)
def residue_probability(t):
    out = S.residue_probability(t.model_outputs("logits", whole=True).withColumn("len", F.lit(32)), ["poi", "pos"], "len")
    return rounded(out.groupBy("poi", "aa").agg(F.avg("probability").alias("probability"), F.max("probability").alias("peak")))


_MASKED = "SELECT concat(poi, '/', chain) AS key, concat(substr(seq, 1, 4), '*', substr(seq, 6, 9), '*', substr(seq, 16)) AS seq FROM {wt}"


@query("restore_masked", "D16", """
SELECT m.key, substr(m.seq, 1, 4) || a.aa || substr(m.seq, 6, 9) || b.aa || substr(m.seq, 16) AS restored FROM mk m
JOIN best a ON a.key = m.key AND a.pos = 5 JOIN best b ON b.key = m.key AND b.pos = 15""", {
    "mk": _MASKED,
    "best": "SELECT concat(poi, '/', chain) AS key, pos, chr(-max(struct_pack(l := logit, a := -ascii(aa))).a) AS aa FROM {chain_logits} WHERE pos IN (5, 15) GROUP BY ALL"})
def restore_masked(t):
    """All chains of every wild type."""
    return S.restore_masked(t.sql(_MASKED), t.model_outputs("chain_logits", "key"), "key", "seq").select("key", "restored")


def _length_model(batches):
    for b in batches:
        yield b.assign(score=b["seq"].str.len().astype("float64"))[["seq_hash", "score"]]


_CACHED = "SELECT sha256(upper(trim(replace(text, 'ß', 'SS')))) AS seq_hash FROM {documents} WHERE lang = 'en'"


def _cache_table(t):
    """Outputs that an earlier run left for the English texts."""
    return t("documents").filter("lang = 'en'").select(S.sequence_hash(F.col("text")).alias("seq_hash"), F.lit(-1.0).alias("score")).distinct()


@query("infer_with_cache", "D17", """
SELECT doc_id, CASE WHEN seq_hash IN (SELECT seq_hash FROM cached) THEN -1.0 ELSE length(u)::double END AS score, seq_hash
FROM (SELECT *, sha256(u) AS seq_hash FROM (SELECT doc_id, upper(trim(replace(text, 'ß', 'SS'))) AS u FROM {documents}))""", {"cached": _CACHED})
def infer_with_cache(t):
    cache = _cache_table(t)
    rows, _, _ = S.infer_with_cache(t("documents").select("doc_id", "text"), "text", cache, _length_model)
    return rounded(rows.select("doc_id", "score", "seq_hash"))


@query("infer_cache_counts", "D17", """
SELECT count(*) FILTER (h IN (SELECT seq_hash FROM cached)) AS hits, count(*) FILTER (h NOT IN (SELECT seq_hash FROM cached)) AS misses
FROM (SELECT DISTINCT sha256(upper(trim(replace(text, 'ß', 'SS')))) AS h FROM {documents})""", {"cached": _CACHED})
def infer_cache_counts(t):
    cache = _cache_table(t)
    return S.infer_with_cache(t("documents").select("doc_id", "text"), "text", cache, _length_model)[2]


# Weights of the demonstration scorer, widened to every residue.
TOY_WEIGHTS = {a: 0.0 for a in "ACDEFGHIKLMNPQRSTVWY"} | {"S": 0.29, "E": 0.72, "R": 0.60, "V": 0.12, "Y": 0.93}
_WSQL = "CASE {} WHEN 'S' THEN 0.29 WHEN 'E' THEN 0.72 WHEN 'R' THEN 0.6 WHEN 'V' THEN 0.12 WHEN 'Y' THEN 0.93 ELSE 0.0 END"


@query("toy_score", "D19", f"""
SELECT p.rid, round(cast(sum({_WSQL.format('mt')} - {_WSQL.format('wt')} - 0.01 * (pos - 1)) AS double), 6) + 0.0::double AS mock_score
FROM parsed p JOIN {{heavy_mut}} h ON h.rid = p.rid AND regexp_full_match(mutant, '[A-Z][0-9]+[A-Z](:[A-Z][0-9]+[A-Z])*') GROUP BY p.rid""", _TOKENS)
def toy_score(t):
    valid = t("heavy_mut").filter("mutant rlike '^[A-Z][0-9]+[A-Z](:[A-Z][0-9]+[A-Z])*$'")
    return rounded(S.toy_score(valid, TOY_WEIGHTS, "rid"))


@query("token_weighted_perplexity", "D20", f"""
SELECT o_orderpriority, {rnd('sum(o_totalprice / 1e5 * n) / nullif(sum(n), 0)', 'loss')}, {rnd('exp(least(20, sum(o_totalprice / 1e5 * n) / nullif(sum(n), 0)))', 'perplexity', 4)}
FROM (SELECT *, o_custkey % 7 AS n FROM {{orders}}) GROUP BY o_orderpriority""")
def token_weighted_perplexity(t):
    rows = t("orders").select("o_orderpriority", (F.col("o_totalprice") / 1e5).alias("loss"), (F.col("o_custkey") % 7).alias("tokens"))
    out = S.token_weighted_perplexity(rows, groups=["o_orderpriority"])
    return rounded(out.withColumn("perplexity", F.round("perplexity", 4)))

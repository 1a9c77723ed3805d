"""Cleaning, label and text queries (inventory B, D18, J14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import clean as C
from .registry import query, rnd, rounded, spread


@query("clean_text_residues", "B2", """
SELECT doc_id, md5(r) AS cleaned, length(r) AS n FROM (
SELECT doc_id, regexp_replace(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z]', '', 'g'), '[UZOB]', 'X', 'g') AS r FROM {documents}) WHERE r <> ''""")
def clean_text_residues(t):
    rows = t("documents").select("doc_id", X.clean_sequence(F.col("text"), "residues").alias("r")).filter("r IS NOT NULL")
    return rows.select("doc_id", F.md5("r").alias("cleaned"), F.length("r").cast("long").alias("n"))


@query("clean_names", "B2", """
SELECT p_partkey, CASE WHEN a = 'NAN' THEN '' ELSE a END AS trimmed, upper(regexp_replace(p_name, '[^\\p{{L}}]', '', 'g')) AS letters,
       CASE WHEN regexp_full_match(b, '[A-IK-Z]+') THEN b END AS strict
FROM (SELECT *, upper(regexp_replace(p_name, '\\s+', '', 'g')) AS a, upper(regexp_replace(p_brand || '-' || p_name, '[\\s\\-_.]', '', 'g')) AS b FROM {part})
""".replace("{{L}}", "L"))
def clean_names(t):
    return t("part").select(
        "p_partkey",
        X.clean_sequence(F.col("p_name"), "trim").alias("trimmed"),
        X.clean_sequence(F.col("p_name"), "letters").alias("letters"),
        X.clean_sequence(F.concat("p_brand", F.lit("-"), "p_name"), "strict").alias("strict"),
    )


_PAIR = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat(c_mktsegment, '|', c_name) WHEN c_custkey % 5 = 1 THEN c_name
 WHEN c_custkey % 5 = 2 THEN concat('|', c_name) ELSE concat(c_name, '|a|b') END AS ab FROM {customer}"""


@query("split_and_join_chains", "B3 B4", f"""
SELECT c_custkey, hc, lc,
       CASE WHEN coalesce(hc, '') <> '' AND coalesce(lc, '') <> '' THEN hc || 'GGGGSGGGGSGGGGS' || lc ELSE coalesce(hc, '') || coalesce(lc, '') END AS linked,
       coalesce(hc, '') || 'GGGGSGGGGSGGGGS' || coalesce(lc, '') AS always, coalesce(hc, '') || '|' || coalesce(lc, '') AS bar
FROM (SELECT c_custkey, split_part(ab, '|', 1) AS hc,
             CASE WHEN instr(ab, '|') > 0 THEN substr(ab, instr(ab, '|') + 1) END AS lc FROM ({_PAIR}))""")
def split_and_join_chains(t):
    both = X.split_antibody(F.col("ab"))
    rows = t.sql(_PAIR).select("c_custkey", both["hc"].alias("hc"), both["lc"].alias("lc"))
    joined = [X.join_chains(F.col("hc"), F.col("lc"), s).alias(s) for s in ("linked", "always", "bar")]
    return rows.select("*", *joined)


_KD = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0E0 ELSE o_totalprice * 1E-9 END AS kd FROM {orders}"


@query("kd_labels", "B5", f"""
SELECT o_orderkey, {rnd('-log10(k)', 'pkd')}, {rnd('ln(k)', 'lnkd')}, {rnd('8.314 / 4184 * 298.15 * ln(k)', 'kcal')}, {rnd('1e9 * pow(10, log10(k))', 'kd_nm', 4)}
FROM (SELECT o_orderkey, CASE WHEN kd > 0 THEN kd END AS k FROM ({_KD}))""")
def kd_labels(t):
    kd = F.col("kd")
    back = F.round(F.lit(1e9) * L.label_to_kd(F.col("raw_pkd")), 4) + F.lit(0.0)
    raw = t.sql(_KD).select("o_orderkey", kd, L.kd_to_label(kd).alias("raw_pkd"), L.kd_to_label(kd, "lnkd").alias("lnkd"), L.kd_to_label(kd, "kcal").alias("kcal"))
    return rounded(raw.select("o_orderkey", F.col("raw_pkd").alias("pkd"), "lnkd", "kcal", back.alias("kd_nm")))


_PROFILES = sorted(L.PROFILE_FACTORS)


@query("affinity_units", "B6", "SELECT row_idx, " + ", ".join(
    rnd(f"ln(CASE WHEN try_cast(kd_text AS double) > 0 THEN try_cast(kd_text AS double) * ({f}) * 1e9 END)", p, 8) for p, f in (
        ("ec50_table", "1e6 / 150000 * 1e-9"), ("elisa_ng_ml_trainer", "1e-9 / 150000"), ("elisa_ug_ml_table", "1 / 150e6"),
        ("elisa_ug_ml_trainer", "1e-6 / 150000"), ("ic50_ug_ml", "1000.0 / 150000 * 1e-9"), ("kd_nm", "1e-9"))) + " FROM {affinity}")
def affinity_units(t):
    def log_nm(p):
        nm = L.affinity_to_kd(F.col("kd_text"), p)["kd_nm"]
        return F.log(F.when(nm > 0, nm)).alias(p)

    return rounded(t("affinity").select("row_idx", *[log_nm(p) for p in _PROFILES if p != "kd_molar"]), 8)


_MULTI = """SELECT row_idx, kd_text AS `IC50 [ug/mL]`, CASE WHEN row_idx % 2 = 0 THEN kd_text END AS `Affinity_Kd_nM`, ag_name FROM {affinity}"""


@query("pick_affinity_source", "B7", f"""
SELECT row_idx, CASE WHEN (SELECT count(try_cast(kd_text AS double)) >= count(CASE WHEN row_idx % 2 = 0 THEN try_cast(kd_text AS double) END) FROM {{affinity}})
       THEN 'surrogate_ic50' ELSE 'molar_direct' END AS affinity_source_kind, {rnd('try_cast(kd_text AS double) * 1000.0 / 150000', 'kd_nm')} FROM {{affinity}}""")
def pick_affinity_source(t):
    out = C.pick_affinity_source(t.sql(_MULTI))
    return rounded(out.select("row_idx", "affinity_source_kind", (F.col("KD(M)") * 1e9).alias("kd_nm")))


_RAW_TRAINING = """SELECT o_orderkey AS row_idx, concat(o_orderpriority, 'UZ') AS Ag_seq,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(o_orderstatus, '-ab|', cast(o_custkey as string), 'x') END AS antibody_sequence,
 CASE WHEN o_orderkey % 97 = 0 THEN 'n.d.' ELSE cast(cast(floor(o_totalprice) as bigint) as string) END AS Kd_nM FROM {orders}"""
_AZ = "nullif(regexp_replace(regexp_replace(upper({}), '[^A-Z]', '', 'g'), '[UZOB]', 'X', 'g'), '')"


@query("standardize_for_training", "B8 B1 B3", f"""
SELECT row_idx, {_AZ.format('Ag_seq')} AS "Antigen", {_AZ.format("split_part(antibody_sequence, '|', 1)")} AS "HC",
       {_AZ.format("split_part(antibody_sequence, '|', 2)")} AS "LC",
       coalesce({_AZ.format("split_part(antibody_sequence, '|', 1)")}, '') || '|' || coalesce({_AZ.format("split_part(antibody_sequence, '|', 2)")}, '') AS "Antibody",
       {rnd('-log10(try_cast(Kd_nM AS double) * 1e-9)', 'affinity')}, 'molar_direct' AS affinity_source_kind, true AS kd_metrics_enabled
FROM ({_RAW_TRAINING})""")
def standardize_for_training(t):
    out = C.standardize_for_training(t.sql(_RAW_TRAINING))
    return rounded(out.select("row_idx", "Antigen", "HC", "LC", "Antibody", "affinity", "affinity_source_kind", "kd_metrics_enabled"))


_KINDS = "SELECT CASE WHEN o_orderkey % 1000 = 7 THEN concat('AbSKEMPI-', cast(o_custkey as string)) ELSE 'plain' END AS Ab_name, o_orderstatus AS Ag_name FROM {orders}"


@query("detect_dataset_kind", "B9", f"""
SELECT bool_or(regexp_matches(Ab_name, '(?i)bindinggym')) AS is_dms, bool_or(regexp_matches(Ab_name, '(?i)ab-?bind')) AS is_ddg_native,
       bool_or(regexp_matches(Ab_name, '(?i)skempi')) AS is_repeat_complexes, bool_or(regexp_matches(Ab_name, '(?i)abcov')) AS is_neutralisation,
       (SELECT round(max(n) / sum(n), 6) + 0.0 FROM (SELECT count(*) AS n FROM k GROUP BY Ag_name)) AS dominant_share,
       (SELECT max(n) / sum(n) > 0.8 FROM (SELECT count(*) AS n FROM k GROUP BY Ag_name)) AS use_random_split
FROM k""", {"k": _KINDS})
def detect_dataset_kind(t):
    return rounded(C.detect_dataset_kind(t.sql(_KINDS)))


@query("filter_affinity", "B10", f"""
SELECT row_idx, {rnd('try_cast(kd_text AS double)', 'kd')}, 'capped' AS profile_tag FROM {{affinity}}
WHERE kd_text NOT LIKE '<%' AND try_cast(kd_text AS double) > 0 AND try_cast(kd_text AS double) <= 100000""")
def filter_affinity(t):
    rows = t("affinity").select("row_idx", "kd_text", F.col("kd_text").alias("kd"))
    out = C.filter_affinity(rows, "kd", kd_max=100000, censored="kd_text", tags={"profile_tag": "capped"})
    return rounded(out.select("row_idx", "kd", "profile_tag"))


_NAMES = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('/data/models/', s_name, '/epoch ', cast(s_nationkey as string))
 WHEN s_suppkey % 7 = 0 THEN concat('/data/MAGE/', s_name) WHEN s_suppkey % 11 = 0 THEN '  ' ELSE concat('org/', s_name, ':v1') END AS name FROM {supplier}"""


@query("model_keys", "B11", f"""
SELECT s_suppkey, regexp_replace(canon, '[^A-Za-z0-9._-]+', '_', 'g') AS model_key,
       regexp_replace(replace(raw, '/', '__'), '[^A-Za-z0-9._-]', '_', 'g') || '__' || substr(sha256(raw), 1, 8) AS model_tag,
       coalesce(nullif(regexp_replace(regexp_replace(trim(name), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS token,
       regexp_replace(split_part(name, '/', -1), '(.)\\.[^.]*$', '\\1') AS task_key
FROM (SELECT *, coalesce(nullif(trim(name), ''), 'unknown_model') AS raw,
      CASE WHEN trim(name) NOT LIKE '/%' THEN trim(name) WHEN name LIKE '%MAGE%' THEN 'custom/MAGE'
           ELSE 'custom/' || split_part(trim(name), '/', -2) || '_' || split_part(trim(name), '/', -1) END AS canon FROM ({_NAMES}))""")
def model_keys(t):
    name = F.col("name")
    return t.sql(_NAMES).select("s_suppkey", X.model_key(name).alias("model_key"), X.model_tag(name).alias("model_tag"),
                                X.safe_token(name).alias("token"), X.task_key(name).alias("task_key"))


_COMPLEX = "SELECT doc_id AS row_idx, text AS HC, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS LC, source AS Antigen FROM {documents}"


@query("drop_duplicate_complexes", "B12", f"""
SELECT row_idx, md5(HC) AS hc_md5, LC AS lc, Antigen AS antigen FROM (
SELECT *, row_number() OVER (PARTITION BY HC, LC, Antigen ORDER BY row_idx) AS rn FROM ({_COMPLEX})) WHERE rn = 1""")
def drop_duplicate_complexes(t):
    out = C.drop_duplicate_complexes(t.sql(_COMPLEX))
    return out.select("row_idx", F.md5("HC").alias("hc_md5"), F.col("LC").alias("lc"), F.col("Antigen").alias("antigen"))


_SCORES = "SELECT concat('f', cast(l_suppkey as string)) AS file, CASE WHEN l_suppkey % 4 = 0 THEN '0.0' WHEN l_suppkey % 4 = 1 AND l_linenumber = 3 THEN 'x' ELSE cast(l_linenumber as string) END AS v, l_orderkey FROM {lineitem}"


@query("quarantine_all_zero", "B15", f"""
SELECT file, count(*) AS n, bool_and(coalesce(try_cast(v AS double) = 0, false)) AS moved FROM ({_SCORES}) GROUP BY file""")
def quarantine_all_zero(t):
    moved, kept, _ = C.quarantine_all_zero(t.sql(_SCORES), "file", "v")
    parts = moved.withColumn("moved", F.lit(True)).unionByName(kept.withColumn("moved", F.lit(False)))
    return parts.groupBy("file", "moved").agg(F.count(F.lit(1)).alias("n"))


@query("quarantine_counts", "B15", f"""
SELECT count(*) AS checked, count(*) FILTER (z) AS moved FROM (
SELECT file, bool_and(coalesce(try_cast(v AS double) = 0, false)) AS z FROM ({_SCORES}) GROUP BY file)""")
def quarantine_counts(t):
    return C.quarantine_all_zero(t.sql(_SCORES), "file", "v")[2]


@query("require_label_column", "B16", "SELECT doc_id, coalesce(quality, 0) AS quality FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def require_label_column(t):
    out, label = C.require_columns(t("labels"), ("DMS_score", "quality"), ("toxic",))
    return out.select("doc_id", F.col(label).alias("quality"))


@query("resolve_aliases", "B1", "SELECT c_custkey, c_name AS vh, c_mktsegment AS target, '' AS light FROM {customer}")
def resolve_aliases(t):
    out = C.resolve_columns(t("customer"), {"vh": ("heavy", "C_NAME"), "target": ("c_mktsegment",), "light": ("vl",)}, ignore_case=True, fill_missing="")
    return out.select("c_custkey", "vh", "target", "light")


@query("structure_tokens", "D18", """
SELECT p_partkey, string_agg(substr(a, i, 1) || CASE WHEN (p_partkey * 7 + i * 13) % 100 < 70 THEN '#' ELSE lower(substr(b, i, 1)) END, '' ORDER BY i) AS tokens
FROM (SELECT p_partkey, upper(md5(cast(p_partkey as string))) AS a, upper(md5(p_name)) AS b FROM {part}), (SELECT unnest(range(1, 33)) AS i) GROUP BY p_partkey""")
def structure_tokens(t):
    conf = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: ((F.col("p_partkey") * 7 + i * 13) % 100).cast("double"))
    seq, struct = F.upper(F.md5(F.col("p_partkey").cast("string"))), F.upper(F.md5("p_name"))
    return spread(t("part"), 64).select("p_partkey", X.structure_tokens(seq, struct, conf).alias("tokens"))


@query("truncate_at_terminal", "J14", """
SELECT page_id, CASE WHEN p > 0 THEN substr(html, 1, p + 1) ELSE html END AS cut FROM (
SELECT *, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS p FROM (
SELECT page_id, html, instr(substr(html, 2), '1') AS a, instr(substr(html, 2), '2') AS b FROM {pages}))""")
def truncate_at_terminal(t):
    return t("pages").select("page_id", X.truncate_at_terminal(F.col("html")).alias("cut"))

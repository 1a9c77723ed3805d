"""Record, candidate, alignment and file queries (inventory J, K, A)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import alignments as K
from ..operators import metrics as M
from ..operators import records as J
from ..session import checkpoint_dir
from ..sources import sequences as Q
from ..sources import tables as A
from .registry import chain_sequence, fixture, query, rnd, rounded
from .split_queries import _SIMPLE

_VH, _VL, _EP = (chain_sequence(c, "c_custkey") for c in ("vh", "vl", "ep"))

# Records from customers: located CDR text, with a wrong CDR on every 37th row
# and an empty light chain on every 41st.
fixture("raw_records", f"""
SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS ID, c_mktsegment AS Antigen, {_EP} AS epitope,
       lower({_VH}) AS H, CASE WHEN c_custkey % 41 = 0 THEN '-' ELSE {_VL} END AS L,
       substr({_VH}, 5, 4) AS HCDR1, CASE WHEN c_custkey % 37 = 0 THEN 'WWWW' ELSE substr({_VH}, 14, 5) END AS HCDR2, substr({_VH}, 24, 6) AS HCDR3,
       CASE c_custkey % 4 WHEN 0 THEN 'Active' WHEN 1 THEN ' binder ' WHEN 2 THEN 'inactive' ELSE '1' END AS status, cast(c_acctbal AS string) AS ec50
FROM {{customer}}
""")


# Row-wise location of the three CDRs, each from the end of the previous one first.
_LOCATED = """
SELECT *, CASE WHEN instr(substr(vh, e2 + 1), HCDR3) > 0 THEN e2 + instr(substr(vh, e2 + 1), HCDR3) ELSE instr(vh, HCDR3) END - 1 AS s3 FROM (
SELECT *, s2 + length(HCDR2) AS e2 FROM (
SELECT *, CASE WHEN instr(substr(vh, s1 + length(HCDR1) + 1), HCDR2) > 0 THEN s1 + length(HCDR1) + instr(substr(vh, s1 + length(HCDR1) + 1), HCDR2) ELSE instr(vh, HCDR2) END - 1 AS s2 FROM (
SELECT *, upper(H) AS vh, instr(upper(H), HCDR1) - 1 AS s1 FROM {raw_records})))"""
_RECORD_COLUMNS = """row_idx, CASE WHEN trim(ID) = '' THEN printf('record_%05d', row_idx) ELSE ID END AS record_id, Antigen AS target, epitope, vh, L AS vl,
 concat(s1, '-', s1 + length(HCDR1), ',', s2, '-', s2 + length(HCDR2), ',', s3, '-', s3 + length(HCDR3)) AS ranges,
 '1' || epitope || 'GGGGSGGGGSGGGGS' || vh || 'GGGGSGGGGSGGGGS' || L || '2' AS serialized"""
_GOOD = "s1 >= 0 AND s2 >= 0 AND s3 >= 0 AND L <> '-'"


# One record stands for so many plain rows: three texts are located in it, and it has hundreds of children.
RECORD_WORK = 1000


def _records(t, **kw):
    return J.load_records(t.spread("raw_records", RECORD_WORK), row_idx="row_idx", **kw)


def _flat(df):
    ranges = F.array_join(F.transform("hcdr_ranges", lambda r: F.concat(r["start"], F.lit("-"), r["end"])), ",")
    return df.select("row_idx", "record_id", "target", "epitope", "vh", "vl", ranges.alias("ranges"), "serialized")


@query("load_records", "J1 J2 J3 J5", f"SELECT {_RECORD_COLUMNS} FROM loc WHERE {_GOOD} AND lower(trim(status)) IN ('active', 'binder', '1') AND try_cast(ec50 AS double) <= 5000", {"loc": _LOCATED})
def load_records(t):
    return _flat(_records(t, max_ec50=5000))


@query("load_all_records", "J1 J3", f"SELECT {_RECORD_COLUMNS} FROM loc WHERE {_GOOD}", {"loc": _LOCATED})
def load_all_records(t):
    return _flat(_records(t, active_only=False))


@query("filter_records", "J2", "SELECT row_idx FROM {raw_records} WHERE lower(trim(status)) = 'binder' AND try_cast(ec50 AS double) <= 2500 AND upper(Antigen) = 'BUILDING'")
def filter_records(t):
    rows = J.filter_potency(J.filter_active(t("raw_records"), "status", ["Binder"]), "ec50", 2500)
    return J.filter_target(rows, "Antigen", "building").select("row_idx")


_RANGED = """SELECT c_custkey AS row_idx, '' AS one, CASE c_custkey % 5 WHEN 0 THEN '5-8; 14:18|24..29' WHEN 1 THEN '[[5, 8], [14, 18]]' WHEN 2 THEN '' WHEN 3 THEN '30-40' ELSE 'x-y' END AS hcdrs FROM {customer}"""


@query("cdr_range_list", "J3 J4", """
SELECT row_idx, CASE row_idx % 5 WHEN 0 THEN '4-8,13-18,23-29' WHEN 1 THEN '4-8,13-18' WHEN 2 THEN '' END AS ranges,
       CASE row_idx % 5 WHEN 0 THEN 15 WHEN 1 THEN 9 WHEN 2 THEN 0 END AS positions FROM (SELECT c_custkey AS row_idx FROM {customer})""")
def cdr_range_list(t):
    rows = J.cdr_ranges(t.sql(_RANGED).withColumn("vh", F.lit("A" * 32)), "vh")
    text = F.array_join(F.transform("hcdr_ranges", lambda r: F.concat(r["start"], F.lit("-"), r["end"])), ",")
    return rows.select("row_idx", text.alias("ranges"), F.when(F.col("hcdr_ranges").isNotNull(), F.size(J.cdr_positions("hcdr_ranges"))).alias("positions"))


@query("split_serialized", "J5", "SELECT c_custkey, " + f"{_EP} AS epitope, {_VH} AS vh, {_VL} AS vl FROM {{customer}} WHERE c_custkey % 6 <> 0")
def split_serialized(t):
    rows = t.sql(f"SELECT c_custkey, {_EP} AS e, {_VH} AS h, {_VL} AS l FROM {{customer}}")
    packed = rows.select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("1"), "e", F.lit("2"))).otherwise(X.serialize_record(F.col("e"), F.col("h"), F.col("l"))).alias("s"))
    return packed.select("c_custkey", X.split_serialized(F.col("s")).alias("p")).filter("p IS NOT NULL").select("c_custkey", "p.*")


@query("drop_long", "J6", "SELECT doc_id, n_dropped FROM {documents}, (SELECT count(*) AS n_dropped FROM {documents} WHERE length(text) > 800) WHERE length(text) <= 800")
def drop_long(t):
    from ..functions.ordering import attach_row

    kept, dropped = J.drop_long(t("documents").select("doc_id", "text"), "text", 800)
    return attach_row(kept.select("doc_id"), dropped.withColumnRenamed("dropped", "n_dropped"))


# ---------------------------------------------------------------- candidate search

@F.arrow_udf(T.DoubleType())
def _site_scores(texts: pa.Array) -> pa.Array:
    """``sum((code(i) * (i % 7 + 1)) % 23)`` over the letters of each text, for all texts of one length at once."""
    out, raw = np.zeros(len(texts)), [None if x is None else x.encode("utf-32-le") for x in texts.to_pylist()]
    sizes = np.array([-1 if x is None else len(x) for x in raw])
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        codes = np.frombuffer(b"".join([raw[i] for i in at]), dtype="<u4").reshape(len(at), size // 4).astype(np.int64)
        out[at] = (codes * (np.arange(1, size // 4 + 1) % 7 + 1) % 23).sum(axis=1)
    return pa.array(out, mask=sizes < 0)


def _scorer(df):
    """Additive site scores: the sum over all residues of a rule-based weight."""
    return df.withColumn("score", _site_scores("vh"))


_SITE_SCORE = "(SELECT sum(((ascii(substr(vh, i, 1)) * (i % 7 + 1)) % 23))::double FROM (SELECT unnest(range(1, 33)) AS i))"


def _kids_sql(spots: str) -> str:
    """Every other residue at every listed spot; the first parent of a text wins."""
    made = "substr(vh, 1, p) || aa || substr(vh, p + 2)"
    return f"""SELECT *, {_SITE_SCORE} AS score FROM (SELECT row_idx, parent, record_id, epitope, vl, p, spot, aa, {made} AS vh,
        row_number() OVER (PARTITION BY epitope, {made}, vl ORDER BY parent, spot, aa) AS rn FROM {spots}, {{residues}} WHERE aa <> substr(vh, p + 1, 1)) WHERE rn = 1"""


_BEAM = {
    "loc": _LOCATED, "rec": f"SELECT {_RECORD_COLUMNS} FROM loc WHERE {_GOOD}",
    "spots": """SELECT row_idx, row_idx AS parent, record_id, vh, epitope, vl, p, row_number() OVER (PARTITION BY row_idx ORDER BY o) AS spot FROM (
        SELECT row_idx, record_id, vh, epitope, vl, p, min(r * 100 + p) AS o FROM (
        SELECT *, unnest(range(cast(split_part(rg, '-', 1) AS bigint), cast(split_part(rg, '-', 2) AS bigint))) AS p FROM (
        SELECT row_idx, record_id, vh, epitope, vl, unnest(string_split(ranges, ',')) AS rg, generate_subscripts(string_split(ranges, ','), 1) AS r FROM rec)) GROUP BY ALL)""",
    "kids": _kids_sql("spots")}


@query("beam_step", "J7 C11", f"""
SELECT row_number() OVER (ORDER BY score DESC, parent, spot, aa) AS place, record_id AS seed_id, vh, {rnd('score', 'score')} FROM kids
ORDER BY score DESC, parent, spot, aa LIMIT 100""", _BEAM)
def beam_step(t):
    best = J.beam_step(J.as_candidates(_records(t, active_only=False)), _scorer, 100)
    placed = J._placed(best)
    return rounded(placed.select((F.col("place") + 1).alias("place"), "seed_id", "vh", "score"))


def _best_sql(kids: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY score DESC, parent, spot, aa) - 1 AS place FROM {kids} ORDER BY place LIMIT 60"


# Two rounds written out: the 20 best of the first are the parents of the second, which leaves their first site alone.
@query("beam_search", "J8", f"""
SELECT '{X.START_TERMINAL}' || epitope || '{X.LINKER}' || vh || '{X.LINKER}' || vl || '{X.END_TERMINAL}' AS serialized, {rnd('score', 'score')}, cast(r AS int) AS round FROM (
SELECT *, row_number() OVER (PARTITION BY epitope, vh, vl ORDER BY r) AS seen FROM (SELECT *, 1 AS r FROM first_best UNION ALL SELECT *, 2 AS r FROM second_best))
WHERE seen = 1 ORDER BY score DESC, r, place LIMIT 60""", _BEAM | {
    "first_best": _best_sql("kids"),
    "more_spots": "SELECT b.row_idx, b.place AS parent, b.record_id, b.vh, b.epitope, b.vl, s.p, s.spot FROM first_best b JOIN spots s ON s.row_idx = b.row_idx AND s.p <> b.p WHERE b.place < 20",
    "more_kids": _kids_sql("more_spots"),
    "second_best": _best_sql("more_kids")})
def beam_search(t):
    """Iterative search; the tests compare it with an exhaustive search too."""
    out = J.beam_search(_records(t, active_only=False), _scorer, rounds=2, beam=20, final=60)
    return rounded(out.select("serialized", "score", "round"))


_CANDS = """SELECT s_suppkey, concat('seed', cast(s_nationkey AS string)) AS seed_id, 'T' AS target, s_acctbal AS score, 1 AS round, s_suppkey AS place,
 concat('H', cast(s_suppkey AS string), 'A>T') AS m, 'EP' AS epitope, 'VH' AS vh, 'VL' AS vl, s_name AS serialized FROM {supplier}"""


def _cands(t):
    return t.sql(_CANDS).withColumn("mutations", F.array("m", F.lit("H2C>S")))


_TABLE_SQL = """SELECT rk AS rank, printf('seed_%05d', dense_rank() OVER (ORDER BY f)) AS seed_id, 'redacted' AS target, 2 AS mutation_count, m || ';H2C>S' AS mutations,
 printf('%.8f', score) AS log_likelihood, epitope, vh, vl, serialized FROM (SELECT *, min(rk) OVER (PARTITION BY seed_id) AS f FROM (SELECT *, row_number() OVER (ORDER BY score DESC, round, place) AS rk FROM c))"""


@query("candidate_table", "J9", _TABLE_SQL, {"c": _CANDS})
def candidate_table(t):
    return J.candidate_table(_cands(t))


@query("prediction_inputs", "A12", """
SELECT printf('candidate_%03d', rk) AS name, '{"name":"' || printf('candidate_%03d', rk) || '","modelSeeds":[1,2,3],"sequences":[{"protein":{"id":"A","sequence":"EP"}},{"protein":{"id":"H","sequence":"VH"}},{"protein":{"id":"L","sequence":"VL"}}],"dialect":"alphafold3","version":1}' AS value
FROM (SELECT row_number() OVER (ORDER BY score DESC, round, place) AS rk FROM c)""", {"c": _CANDS})
def prediction_inputs(t):
    path = _scratch(t, "prediction_inputs")
    A.write_prediction_inputs(J.candidate_table(_cands(t)), path, 3)
    back = t.spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return back.select(F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1).alias("name"), "value")


# ---------------------------------------------------------------- predicted structures

_JSON_FIX = """
SELECT concat('/runs/c', cast(c_nationkey AS string), '/seed', cast(c_custkey AS string), '_summary.json') AS path, c_custkey, c_nationkey,
 concat(chr(123), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('"Ranking_Score": ', cast(cast(c_acctbal AS int) AS string), ', ') END,
 '"ipTM": 0.', cast(10 + c_custkey % 83 AS string), ', "PTM": 0.', cast(10 + c_custkey % 71 AS string), ', "fraction_disordered": 0.25, ',
 CASE WHEN c_custkey % 12 = 0 THEN '' ELSE concat('"Has_Clash": ', CASE WHEN c_custkey % 7 = 0 THEN 'true' ELSE 'false' END, ', ') END, '"x": "y"', chr(125)) AS value FROM (
 SELECT c_custkey, c_nationkey, floor(c_acctbal) AS c_acctbal FROM {customer})"""
_JSON_SQL = {"j": _JSON_FIX, "sc": """SELECT 'c' || c_nationkey AS candidate_id, path AS prediction_file, 0.01 * (10 + c_custkey % 83) AS iptm, 0.01 * (10 + c_custkey % 71) AS ptm, CASE WHEN c_custkey % 3 = 0 THEN
   CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE 0.008 * (10 + c_custkey % 83) + 0.002 * (10 + c_custkey % 71) + 0.125 - CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END END
   ELSE cast(regexp_extract(value, 'Ranking_Score": (-?[0-9]+)', 1) AS double) END AS s FROM j""",
             "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, iptm DESC, prediction_file) AS rn FROM sc WHERE s IS NOT NULL) WHERE rn = 1"}


@query("best_per_candidate", "J10 J11 J12", f"SELECT candidate_id, prediction_file, {rnd('s::double', 'ranking_score')}, {rnd('iptm::double', 'iptm')}, {rnd('ptm::double', 'ptm')} FROM best", _JSON_SQL)
def best_per_candidate(t):
    return rounded(J.best_per_candidate(t.sql(_JSON_FIX)))


@query("top_ranked", "J13", f"""
SELECT row_number() OVER (ORDER BY s DESC, iptm DESC, candidate_id) AS rank, candidate_id, {rnd('s::double', 'ranking_score')}, {rnd('iptm::double', 'iptm')}, {rnd('ptm::double', 'ptm')}, prediction_file FROM best
ORDER BY rank LIMIT 20""", _JSON_SQL)
def top_ranked(t):
    return rounded(J.top_ranked(J.best_per_candidate(t.sql(_JSON_FIX)), 20))


@query("ranking_scores", "J10 J11", f"SELECT prediction_file, candidate_id, {rnd('s::double', 'ranking_score')} FROM sc", _JSON_SQL)
def ranking_scores(t):
    rows = t.sql(_JSON_FIX).select("path", J.metric_map("value").alias("m"))
    return rounded(rows.select(F.col("path").alias("prediction_file"), J.candidate_id("path", "m", "parent", "c[0-9]+").alias("candidate_id"), J.ranking_score("m").alias("ranking_score")))


@query("read_predictions", "A7", "SELECT 'c' || c_nationkey AS candidate, count(*) AS files FROM {customer} GROUP BY c_nationkey")
def read_predictions(t):
    path = _scratch(t, "read_predictions")
    rows = t.sql(_JSON_FIX).select(F.concat(F.lit("c"), "c_nationkey").alias("candidate"), "value")
    # One folder per candidate with a summary document and one that the source must leave out.
    for stem in ("summary", "notes"):
        out = rows.repartition("candidate").write.mode("append").option("mapreduce.output.basename", stem)
        out.partitionBy("candidate").json(path + "/" + stem)
    found = A.read_predictions(t.spark, path)
    name = F.regexp_extract("path", "candidate=([^/]+)/", 1).alias("candidate")
    return found.groupBy(name).agg(F.sum(F.regexp_count("value", F.lit("\n"))).alias("files"))


# ---------------------------------------------------------------- alignments

_MSA = """SELECT s_suppkey AS row_idx, concat(substr(s, 1, cast(s_suppkey % 20 AS int)), '-', substr(s, cast(s_suppkey % 20 AS int) + 2)) AS seq FROM (
SELECT s_suppkey, translate(md5(cast(s_suppkey % 40 AS string)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS s FROM {supplier})"""


@query("msa_identity", "K1", """
SELECT m.row_idx, round((SELECT avg(CASE WHEN substr(q.seq, i, 1) = substr(m.seq, i, 1) THEN 1.0::double ELSE 0 END) FROM (SELECT unnest(range(1, 33)) AS i)), 3) + 0.0 AS identity, m.row_idx = 0 AS is_query
FROM m, (SELECT seq FROM m WHERE row_idx = 0) q""", {"m": _MSA})
def msa_identity(t):
    return rounded(K.by_identity(K.msa_identity(t.sql(_MSA)))).select("row_idx", "identity", "is_query")


@query("greedy_diverse", "K2", "SELECT row_idx, CASE WHEN (SELECT count(*) FROM m) > 12 THEN step END AS pick FROM rec WHERE chosen", {"m": _MSA, "rec": """
SELECT 0 AS step, row_idx, seq, k, 0.0::double AS s, k = min(k) OVER () AS chosen, k = min(k) OVER () AS taken FROM (SELECT row_idx, seq, md5('3|' || row_idx) AS k FROM m)
UNION ALL SELECT step + 1, row_idx, seq, k, s, chosen, taken OR chosen FROM (
SELECT step, row_idx, seq, k, s, taken, NOT taken AND row_number() OVER (ORDER BY taken, round(s, 9) DESC, k) = 1 AS chosen FROM (
SELECT step, row_idx, seq, k, taken, s + 1 - list_sum(list_transform(range(1, 33), lambda i: CASE WHEN substr(q, i, 1) = substr(seq, i, 1) THEN 1.0::double ELSE 0.0 END)) / 32 AS s
FROM (SELECT *, max(CASE WHEN chosen THEN seq END) OVER () AS q FROM rec)) WHERE step < 11)"""})
def greedy_diverse(t):
    return K.greedy_diverse(t.sql(_MSA), n=12, seed=3).select("row_idx", "pick")


_NUMBERED = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'H' ELSE 'L' END AS chain, cast(30 + c_nationkey % 5 AS string) AS position,
 CASE WHEN c_custkey % 3 = 0 THEN 'A' WHEN c_custkey % 3 = 1 THEN ' ' ELSE 'B' END AS insertion, CASE WHEN c_custkey % 11 = 0 THEN '-' ELSE substr(c_mktsegment, 1, 1) END AS residue, c_custkey % 50 AS seq_id FROM {customer}"""
_ORD = "cast(position AS int) * 100 + CASE WHEN cast(position AS int) = 33 THEN CASE insertion WHEN ' ' THEN 27 WHEN 'A' THEN 26 ELSE 25 END ELSE CASE insertion WHEN ' ' THEN 0 WHEN 'A' THEN 1 ELSE 2 END END"


@query("numbering_axis", "K3", f"""
SELECT chain, position, insertion, cast(row_number() OVER (PARTITION BY chain ORDER BY {_ORD}) - 1 AS int) AS axis_idx FROM (SELECT DISTINCT chain, position, insertion FROM n WHERE residue <> '-')""", {"n": _NUMBERED})
def numbering_axis(t):
    return K.numbering_axis(t.sql(_NUMBERED)).select("chain", "position", "insertion", "axis_idx")


_RESIDUE_SQL = "SELECT seq_id, chain, position, insertion, min(residue) AS residue FROM n WHERE residue <> '-' GROUP BY ALL"


@query("align_to_axis", "K4", """
SELECT s.seq_id, coalesce(string_agg(coalesce(r.residue, '-'), '' ORDER BY x.o) FILTER (x.chain = 'H'), '') || '|' || coalesce(string_agg(coalesce(r.residue, '-'), '' ORDER BY x.o) FILTER (x.chain = 'L'), '') AS aligned
FROM (SELECT DISTINCT seq_id FROM r0) s CROSS JOIN ax x LEFT JOIN r0 r ON r.seq_id = s.seq_id AND r.chain = x.chain AND r.position = x.position AND r.insertion = x.insertion GROUP BY s.seq_id""", {
    "n": _NUMBERED, "r0": _RESIDUE_SQL, "ax": f"SELECT DISTINCT chain, position, insertion, {_ORD} AS o FROM n WHERE residue <> '-'"})
def align_to_axis(t):
    rows = t.sql(_NUMBERED).filter("residue <> '-'").groupBy("seq_id", "chain", "position", "insertion").agg(F.min("residue").alias("residue"))
    return K.align_to_axis(rows, K.numbering_axis(rows), "seq_id")


# ---------------------------------------------------------------- files

def _scratch(t, name: str) -> str:
    """Folder for a written copy of derived data, in the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(t.spark)}/files-{name}-{uuid.uuid4().hex[:12]}"


@query("read_mutations", "A1", f"SELECT rid AS mutation_id, seq AS wildtype_sequence, mutant, {rnd('label', 'DMS_score', 4)} FROM {{heavy_mut}}")
def read_mutations(t):
    path = _scratch(t, "read_mutations") + ".tsv"
    t("heavy_mut").select(F.col("rid").alias("mutation_id"), F.col("seq").alias("wildtype_sequence"), "mutant", F.col("label").alias("DMS_score")).write.option("header", True).option("sep", "\t").csv(path)
    return rounded(A.read_mutations(t.spark, path, schema="mutation_id string, wildtype_sequence string, mutant string, DMS_score double"), 4)


@query("read_records", "A2", "SELECT 'csv' AS kind, c_name, c_mktsegment FROM {customer} UNION ALL SELECT 'jsonl', c_name, c_mktsegment FROM {customer}")
def read_records(t):
    src, out = t("customer").select("c_name", "c_mktsegment"), None
    for kind in ("csv", "jsonl"):
        path = _scratch(t, f"read_records_{kind}")
        src.write.option("header", True).option("sep", ";").csv(path) if kind == "csv" else src.write.json(path)
        part = A.read_records(t.spark, path, kind, sep=";").select(F.lit(kind).alias("kind"), "c_name", "c_mktsegment")
        out = part if out is None else out.unionByName(part)
    return out


@query("evaluate_scored_files", "A3 E9 B13 B14", f"""
SELECT model, n, {rnd('CASE WHEN min_l < max_l AND min_p < max_p THEN r END', 'spearman')} FROM (
SELECT model, count(*) AS n, corr(ry, rp) AS r, min(label) AS min_l, max(label) AS max_l, min(pred) AS min_p, max(pred) AS max_p FROM (
SELECT *, (rank() OVER (PARTITION BY model ORDER BY label)) + (count(*) OVER (PARTITION BY model, label) - 1) / 2.0 AS ry,
       (rank() OVER (PARTITION BY model ORDER BY pred)) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0 AS rp FROM (
SELECT 'm1' AS model, value AS label, pred FROM (SELECT label AS value, pred FROM {{scored_events}}) UNION ALL
SELECT 'm2', label, -pred FROM {{scored_events}})) GROUP BY model)""")
def evaluate_scored_files(t):
    root = _scratch(t, "scored") + "/root"
    ev = t("scored_events")
    ev.select(F.col("label").alias("DMS_score"), F.col("pred").alias("a_score")).write.option("header", True).csv(root + "/m1/x")
    # Another column order, an extra column and two scores: read by its own header, the preferred score first.
    ev.select(F.lit("k").alias("note"), F.col("pred").alias("masked_score"), (-F.col("pred")).alias("wt_score"), F.col("label").alias("DMS_score")).write.option("header", True).csv(root + "/m2/x")
    files = A.read_scored_files(t.spark, root, score_preference=("wt_score", "masked_score")).filter("status = 'ok'")
    return rounded(M.evaluate(files, ["model"], "label", "pred").select("model", "n", "spearman"))


# Files of three kinds, one per group: a score that the header names but no row holds, no score, and a preferred score.
@query("correlate_scored_files", "A3 E8", f"""
SELECT file, CASE WHEN model = 'm3' THEN round(CASE WHEN v THEN corr(label, pred) END, 6) + 0.0 END AS pearson,
       CASE WHEN model = 'm3' THEN round(CASE WHEN v THEN corr(ry, rp) END, 6) + 0.0 END AS spearman,
       CASE WHEN model = 'm2' THEN 'missing' WHEN model = 'm1' OR NOT v THEN 'zero variance' ELSE 'computed' END AS status
FROM (SELECT model, model || '/' || grp AS file, label, pred, v, ry, rp FROM w, (SELECT unnest(['m1', 'm2', 'm3']) AS model)) GROUP BY model, file, v""", {
    "w": """SELECT *, min(label) OVER g < max(label) OVER g AND min(pred) OVER g < max(pred) OVER g AS v,
            (rank() OVER (PARTITION BY grp ORDER BY label)) + (count(*) OVER (PARTITION BY grp, label) - 1) / 2.0 AS ry,
            (rank() OVER (PARTITION BY grp ORDER BY pred)) + (count(*) OVER (PARTITION BY grp, pred) - 1) / 2.0 AS rp
            FROM {scored} WHERE label IS NOT NULL AND pred IS NOT NULL WINDOW g AS (PARTITION BY grp)"""})
def correlate_scored_files(t):
    folder = _scratch(t, "correlate")
    root, parsed = f"{folder}/root", f"{folder}/parsed"
    rows = t("scored").dropna(subset=["label", "pred"]).select("grp", F.col("label").alias("DMS_score"), "pred").repartition("grp")
    for model, scores in {"m1": [F.lit(None).cast("double").alias("wt_score"), F.col("pred").alias("masked_score")], "m2": [F.col("pred").alias("note")],
                          "m3": [F.col("pred").alias("masked_score"), F.lit("a, b").alias("note")]}.items():
        rows.select("grp", *scores, "DMS_score").write.option("header", True).partitionBy("grp").csv(f"{root}/{model}")
    choice = ("wt_score", "masked_score")
    # One row per file, read from the files once and not for each use.
    heads = A.scored_file_headers(t.spark, root, score_preference=choice).withColumn("file", F.concat_ws("/", "model", F.regexp_extract("path", "/grp=([^/]*)/", 1))).checkpoint()
    scored = A.read_scored_files(t.spark, root, headers=heads).withColumn("file", F.concat_ws("/", "model", F.regexp_extract("path", "/grp=([^/]*)/", 1)))
    named = heads.select("file", F.array_compact(F.array(F.when(F.col("label_at").isNotNull(), F.lit("label")), F.when(F.col("pred_at").isNotNull(), F.lit("pred")))).alias("columns"))
    # Statistics and both orders of ranks read the parsed lines; the files are opened once for all of them.
    scored.select("file", "label", "pred").write.parquet(parsed)
    scored = t.spark.read.schema(scored.select("file", "label", "pred").schema).parquet(parsed)
    return rounded(M.per_file_correlation(scored, "file", "label", ["pred"], named))


@query("resolve_assay", "A4", "SELECT p_name || '-' || p_partkey AS assay FROM {part} WHERE p_partkey = 7")
def resolve_assay(t):
    mapping = t("part").select("p_partkey", F.concat("p_name", F.lit("-"), "p_partkey").alias("assay"))
    return A.resolve_assay(mapping, 7, "assay", ["p_partkey"])


@query("fasta_round_trip", "A5", "SELECT concat('d', cast(p_partkey AS string)) AS id, concat('note ', p_type) AS annotation, upper(md5(p_name || p_partkey)) AS seq FROM {part}")
def fasta_round_trip(t):
    path = _scratch(t, "fasta")
    rows = t("part").select(F.concat(F.lit("d"), "p_partkey", F.lit(" note "), "p_type").alias("id"), F.upper(F.md5(F.concat("p_name", "p_partkey"))).alias("seq"))
    Q.write_fasta(rows, path)
    return Q.read_fasta(t.spark, path)


@query("read_a2m", "A6 K1", """
SELECT header, seq, round((SELECT avg(CASE WHEN substr(q, i, 1) = substr(seq, i, 1) THEN 1.0::double ELSE 0 END) FROM (SELECT unnest(range(1, 33)) AS i)), 3) + 0.0 AS identity, row_idx = 0 AS is_query
FROM (SELECT row_idx, 'r' || row_idx AS header, seq, (SELECT seq FROM m WHERE row_idx = 0) AS q FROM m)""", {"m": _MSA})
def read_a2m(t):
    path = _scratch(t, "a2m")
    rows = t.sql(_MSA).select("row_idx", F.concat(F.lit(">r"), "row_idx", F.lit("\n"), F.replace("seq", F.lit("-"), F.lit("x"))).alias("value"))
    # Parts of a range order: their names follow the row numbers.
    rows.repartitionByRange(4, "row_idx").sortWithinPartitions("row_idx").select("value").write.text(path)
    return rounded(Q.read_a2m(t.spark, path).select("header", "seq", "identity", "is_query"))


@query("split_file_round_trip", "A8", "SELECT fold, split, row_idx FROM sp", {"sp": _SIMPLE})
def split_file_round_trip(t):
    path = _scratch(t, "splits")
    A.write_splits(t.sql(_SIMPLE), path, {"size": 1, "seed": 42})
    return A.read_splits(t.spark, path)[0]


@query("scored_partitions", "A10 B11", """
SELECT 'assay_a' AS task, 'org__m_1__' || substr(sha256('org/m 1'), 1, 8) AS model, 'masked' AS mode, 'fp16' AS fp, 'focus1' AS focus, count(*) AS n, round(sum(label), 2) + 0.0 AS total FROM {scored_events}""")
def scored_partitions(t):
    path = _scratch(t, "scored_partitions")
    A.write_scored(t("scored_events"), path, "in/assay_a.csv", "org/m 1", "masked", True, True)
    back = t.spark.read.parquet(path)
    return rounded(back.groupBy("task", "model", "mode", "fp", "focus").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("total")), 2)


@query("manifest_file", "A11", "SELECT 'cluster' AS kind, count(DISTINCT cluster) + 1 AS lines FROM {clustered} UNION ALL SELECT 'summary', 1")
def manifest_file(t):
    path = _scratch(t, "manifest")
    A.write_manifest(t("clustered"), path, "row_idx", "cluster", {"seed": 42})
    return t.spark.read.text(path).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))



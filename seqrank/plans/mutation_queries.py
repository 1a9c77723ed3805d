"""Mutation queries (inventory C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mutation_text as MT
from ..operators import mutations as M
from .registry import query, rnd, rounded

_TOKENS = {
    "tok": "SELECT rid, trim(unnest(string_split(mutant, ':'))) AS t FROM {heavy_mut}",
    "parsed": """SELECT rid, upper(left(t, 1)) AS wt, try_cast(substr(t, 2, length(t) - 2) AS int) AS pos, upper(right(t, 1)) AS mt
                 FROM tok WHERE length(t) >= 3 AND regexp_full_match(substr(t, 2, length(t) - 2), '[+-]?[0-9]+')""",
}


@query("parse_mutations", "C1", "SELECT * FROM parsed", _TOKENS)
def parse_mutations(t):
    return t("heavy_mut").select("rid", F.inline(MT.parse_mutations("mutant")))


_STRICT = "regexp_full_match(mutant, '[A-Z][0-9]+[A-Z](:[A-Z][0-9]+[A-Z])*')"


@query("parse_mutations_strict", "C2", f"SELECT p.* FROM parsed p JOIN {{heavy_mut}} h ON p.rid = h.rid AND {_STRICT}", _TOKENS)
def parse_mutations_strict(t):
    valid = t("heavy_mut").filter("mutant rlike '^[A-Z][0-9]+[A-Z](:[A-Z][0-9]+[A-Z])*$'")
    return valid.select("rid", F.inline(MT.parse_mutations_strict("mutant")))


def _set(seq: str, pos: str, aa: str) -> str:
    return f"(substr({seq}, 1, {pos} - 1) || {aa} || substr({seq}, {pos} + 1))"


_TWO = {
    "two": """SELECT *, split_part(mutant, ':', 1) AS m1, split_part(mutant, ':', 2) AS m2 FROM {heavy_mut}""",
    "pos2": """SELECT *, try_cast(substr(m1, 2, length(m1) - 2) AS int) AS p1, try_cast(substr(m2, 2, length(m2) - 2) AS int) AS p2 FROM two""",
    "done": f"""SELECT *, p1 BETWEEN 1 AND length(seq) AS ok, CASE WHEN p2 IS NULL THEN {_set('seq', 'p1', 'right(m1, 1)')}
                ELSE {_set(_set('seq', 'p1', 'right(m1, 1)'), 'p2', 'right(m2, 1)')} END AS built FROM pos2""",
}


@query("apply_mutations", "C3", "SELECT rid, CASE WHEN ok THEN built END AS mutated FROM done", _TWO)
def apply_mutations(t):
    return t("heavy_mut").select("rid", MT.apply_mutations("seq", "mutant", on_error="null").alias("mutated"))


@query("apply_mutations_checked", "C4", "SELECT rid, CASE WHEN ok THEN built ELSE seq END AS mutated FROM done", _TWO)
def apply_mutations_checked(t):
    return t("heavy_mut").select("rid", MT.apply_mutations_checked("seq", "mutant").alias("mutated"))


@query("shift_mutations", "C5", f"""
SELECT rid, string_agg(left(t, 1) || (cast(substr(t, 2, length(t) - 2) AS int) - 9) || right(t, 1), ':' ORDER BY i) AS shifted, min(mutant) AS back
FROM (SELECT rid, mutant, unnest(string_split(mutant, ':')) AS t, generate_subscripts(string_split(mutant, ':'), 1) AS i FROM {{heavy_mut}} WHERE {_STRICT}) GROUP BY rid""")
def shift_mutations(t):
    valid = t("heavy_mut").filter("mutant rlike '^[A-Z][0-9]+[A-Z](:[A-Z][0-9]+[A-Z])*$'")
    moved = valid.select("rid", MT.shift_mutations("mutant", 10).alias("shifted"))
    return moved.select("rid", "shifted", MT.shift_mutations("shifted", 10, undo=True).alias("back"))


@query("clean_assay", "C6", f"SELECT poi, mutant, built AS mutated_sequence, {rnd('avg(-label)', 'DMS_score')} FROM done WHERE ok GROUP BY poi, mutant, built", _TWO)
def clean_assay(t):
    return rounded(M.clean_assay(t("heavy_mut"), "seq", "mutant", "label", direction=-1.0, groups=("poi",)))


def _part(chain: str, column: str = "mutant") -> str:
    return f"regexp_extract({column}, '''{chain}'': ''([^'']*)''', 1)"


_CHAINS = {
    "rows_": f"""SELECT rid, poi, chain_id, wildtype_sequence AS w, mutant, left(mutant, 1) <> chr(123) AS plain, left(mutant, 1) <> chr(123) AND mutant <> '' AS gstr,
                 {_part('H')} AS mh, {_part('L')} AS ml, {_part('A')} AS ma FROM {{assay}}""",
    "foc": """SELECT poi, bool_or(gstr) AS g, bool_or(mh NOT IN ('', 'nan')) AS fh, bool_or(ml NOT IN ('', 'nan')) AS fl,
              bool_or(ma NOT IN ('', 'nan')) AS fa, min(chain_id) AS ids, min(w) AS w FROM rows_ GROUP BY poi""",
    "ch": f"""SELECT poi, c, CASE c WHEN 'H' THEN {_part('H', 'w')} WHEN 'L' THEN {_part('L', 'w')} ELSE {_part('A', 'w')} END AS s,
              CASE WHEN ids = 'A L H' THEN instr('ALH', c) ELSE instr('HLA', c) END AS o
              FROM foc, (VALUES ('H'), ('L'), ('A')) v(c) WHERE g OR (c = 'H' AND fh) OR (c = 'L' AND fl) OR (c = 'A' AND fa)""",
    "off": """SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY poi ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM ch""",
    "cat": "SELECT poi, string_agg(s, '' ORDER BY o) AS wt_concat, string_agg(c, '' ORDER BY o) AS chains, string_agg(cast(d AS varchar), ',' ORDER BY o) AS offsets FROM off GROUP BY poi",
}


@query("focus_chains", "C7", """SELECT poi, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fh THEN 'H' ELSE '' END, CASE WHEN fl THEN 'L' ELSE '' END) AS focus_chains, g AS has_global FROM foc""",
       {k: _CHAINS[k] for k in ("rows_", "foc")})
def focus_chains(t):
    return M.focus_chains(t("assay"), "poi").withColumn("focus_chains", F.array_join("focus_chains", ""))


@query("concat_chains", "C8", "SELECT poi, coalesce(wt_concat, '') AS wt_concat, coalesce(chains, '') AS chains, coalesce(offsets, '') AS offsets FROM foc LEFT JOIN cat USING (poi)", _CHAINS)
def concat_chains(t):
    out = M.concat_chains(t("assay"), "rid", "poi")
    return out.select("poi", "wt_concat", F.array_join("chains", "").alias("chains"), F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


@query("globalize_mutations", "C9", """
SELECT r.rid, coalesce(cat.wt_concat, '') AS wt_concat, CASE WHEN r.plain THEN r.mutant ELSE coalesce(g.m, '') END AS mutant_global
FROM rows_ r LEFT JOIN cat USING (poi) LEFT JOIN (
  SELECT rid, string_agg(left(tk, 1) || (cast(substr(tk, 2, length(tk) - 2) AS int) + cast(d AS int)) || right(tk, 1), ':' ORDER BY o) AS m
  FROM (SELECT rid, o, d, CASE c WHEN 'H' THEN mh WHEN 'L' THEN ml ELSE ma END AS tk FROM rows_ JOIN off USING (poi)) WHERE length(tk) > 2 AND tk <> 'nan' GROUP BY rid) g USING (rid)""", _CHAINS)
def globalize_mutations(t):
    return M.globalize_mutations(t("assay"), "rid", "poi").select("rid", "wt_concat", "mutant_global")


@query("pick_heavy_light", "C10", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'VH' WHEN 1 THEN 'H' END AS heavy, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'KAPPA' ELSE 'L' END AS light FROM {part}""")
def pick_heavy_light(t):
    heavy = F.when(F.col("p_size") % 3 == 0, "VH").when(F.col("p_size") % 3 == 1, "H").otherwise("Q")
    light = F.when(F.col("p_size") % 5 == 0, "R").when(F.col("p_size") % 2 == 0, "KAPPA").otherwise("L")
    rows = t("part").select("p_partkey", F.create_map(F.lit("A"), F.lit("x"), heavy, F.lit("y"), light, F.lit("z")).alias("chains"))
    return rows.select("p_partkey", M.pick_heavy_light("chains").alias("c")).select("p_partkey", "c.*")


@query("saturate", "C11", """
SELECT poi, chain, position, 'H' || (position + 1) || old || '>' || aa AS mutation, substr(seq, 1, position) || aa || substr(seq, position + 2) AS mutated
FROM (SELECT poi, chain, seq, position, substr(seq, position + 1, 1) AS old FROM {wt}, (VALUES (4), (5), (14), (23)) v(position) WHERE position <> 5) CROSS JOIN {residues} WHERE aa <> old""")
def saturate(t):
    chains = t("wt").withColumn("spots", F.expr("array(4, 5, 14, 23)")).withColumn("taken", F.expr("array(5)"))
    return M.saturate(chains, "seq", "spots", "taken").select("poi", "chain", "position", "mutation", "mutated")

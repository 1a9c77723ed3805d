"""Assay cleaning, multi-chain coordinates and saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mutation_text import RESIDUES, SEPARATOR, _lenient, mutation_problem, place_mutations
from .metrics import to_number

_EMPTY = "('', 'nan', 'none', '<na>')"
# Chain names of paired antibodies.
HEAVY_NAMES = ("H", "VH", "HEAVY")
LIGHT_NAMES = ("L", "VL", "LIGHT", "K", "KAPPA")


def clean_assay(
    df: DataFrame, seq: str, mutant: str, phenotype: str, start: int = 1, end: int | None = None, direction: float = 1.0,
    groups: tuple[str, ...] = (),
) -> DataFrame:
    """Valid mutants with their mean directed label and mutated sequence.

    ``seq`` is a column, so many assays (``groups``) are cleaned in one job.
    """
    last = f"{start} + length({seq}) - 1" if end is None else str(end)
    tokens = f"split({mutant}, '{SEPARATOR}')"
    number = "cast(substring(t, 2, length(t) - 2) AS int)"
    ok = (
        f"forall({tokens}, t -> t rlike '^[{RESIDUES}][0-9]+[{RESIDUES}]$' AND {number} >= {start} AND {number} <= {last} "
        f"AND substring({seq}, {number} - {start} + 1, 1) = left(t, 1))"
    )
    value = to_number(F.col(phenotype))
    rows = df.filter(F.expr(f"{mutant} IS NOT NULL AND {ok}")).select(
        *groups, F.col(seq).alias("_seq"), F.col(mutant).alias("mutant"), (value * F.lit(direction)).alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & (F.abs("_v") != float("inf")))
    mean = rows.groupBy(*groups, "_seq", "mutant").agg(F.avg("_v").alias("DMS_score"))
    return mean.select(*groups, "mutant", place_mutations("_seq", "mutant", start).alias("mutated_sequence"), "DMS_score")


def chain_map(text: str) -> str:
    """SQL of a chain map from its literal text; null for plain mutation strings.

    Text that starts like a literal and doesn't parse is an error.
    """
    json = f"regexp_replace(translate({text}, '\\'', '\"'), ':\\\\s*None', ': null')"
    return f"CASE WHEN ltrim({text}) LIKE '{{%' THEN coalesce(from_json({json}, 'map<string,string>'), raise_error(concat('malformed chain map: ', {text}))) END"


def chain_order(text: str) -> str:
    """SQL of the ordered chain list: ``ABC``, ``A,B,C`` or ``A B C``."""
    t = f"trim({text})"
    pieces = f"CASE WHEN {t} LIKE '%,%' THEN split({t}, ',') WHEN {t} LIKE '% %' THEN split({t}, ' ') ELSE split({t}, '') END"
    kept = f"filter(transform({pieces}, x -> trim(x)), x -> x <> '')"
    return f"CASE WHEN {text} IS NULL OR lower({t}) IN {_EMPTY} THEN cast(array() AS array<string>) ELSE {kept} END"


def _parsed(df: DataFrame, poi: str, mutant: str) -> DataFrame:
    return df.withColumn("_muts", F.expr(chain_map(mutant))).withColumn(
        "_global", F.expr(f"CASE WHEN _muts IS NULL AND {mutant} IS NOT NULL AND lower(trim({mutant})) NOT IN {_EMPTY} THEN regexp_replace(trim({mutant}), '^([\\\\x22\\\\x27])(.*)\\\\1$', '$2') END"))


def _touched() -> Column:
    """Chains of the row that carry a mutation."""
    return F.expr(f"map_keys(map_filter(coalesce(_muts, cast(map() AS map<string,string>)), (k, v) -> v IS NOT NULL AND lower(trim(v)) NOT IN {_EMPTY}))")


def _by_poi(rows: DataFrame, poi: str, *more: Column) -> DataFrame:
    """One aggregate per POI; the set holds distinct chain lists, so it stays as small as the complex."""
    touched = F.array_sort(F.array_distinct(F.flatten(F.collect_set(_touched()))))
    return rows.groupBy(poi).agg(touched.alias("focus_chains"), F.bool_or(F.col("_global").isNotNull()).alias("has_global"), *more)


def focus_chains(df: DataFrame, poi: str = "POI", mutant: str = "mutant") -> DataFrame:
    """Chains with at least one mutation per POI, and whether a plain string occurs."""
    return _by_poi(_parsed(df, poi, mutant), poi)


def concat_chains(
    df: DataFrame, order: str, poi: str = "POI", wt: str = "wildtype_sequence", mutant: str = "mutant",
    chain_id: str = "chain_id", focus: bool = True,
) -> DataFrame:
    """One row per POI: concatenated wild type, kept chains and their offsets.

    The chain list and sequences come from the first row by ``order``; without
    a chain list the key order of the map is used. Silent chains are dropped
    when ``focus`` is set and no row of the POI uses a plain string.
    """
    rows = _parsed(df, poi, mutant)
    first = F.min_by(F.struct(F.col(chain_id).alias("ids"), F.col(wt).alias("wt")), F.col(order)).alias("_first")
    named = _by_poi(rows, poi, first).select(
        poi, "focus_chains", "has_global",
        F.expr(chain_map("_first.wt")).alias("_wt"), F.expr(chain_order("_first.ids")).alias("_ids"))
    keep = "map_contains_key(_wt, c)" + (" AND (has_global OR array_contains(focus_chains, c))" if focus else "")
    ordered = named.withColumn("chains", F.expr(f"filter(if(size(_ids) = 0, map_keys(_wt), _ids), c -> {keep})"))
    parts = ordered.withColumn("_parts", F.expr("transform(chains, c -> upper(regexp_replace(coalesce(_wt[c], ''), '[ \\n\\r]', '')))"))
    return parts.select(
        poi,
        F.array_join("_parts", "").alias("wt_concat"),
        "chains",
        F.expr("transform(_parts, (p, i) -> aggregate(slice(_parts, 1, i), 0, (n, q) -> n + length(q)))").alias("offsets"),
    )


def globalize_mutations(
    df: DataFrame, row_id: str, poi: str = "POI", wt: str = "wildtype_sequence", mutant: str = "mutant",
    chain_id: str = "chain_id", focus: bool = True, order: str | None = None, table: DataFrame | None = None,
) -> DataFrame:
    """Rewrite every per-chain mutation to the concatenated sequence.

    Adds ``wt_concat`` and ``mutant_global``; plain strings pass through. ``table``
    is the output of :func:`concat_chains` when the caller has it already.
    """
    if table is None:
        table = concat_chains(df, order or row_id, poi, wt, mutant, chain_id, focus)
    # Chain maps are parsed after the join, so its shuffle moves the texts only.
    rows = _parsed(df.join(table, poi), poi, mutant)
    shifted = f"transform({_lenient('_muts[c]')}, m -> concat(m.wt, m.pos + offsets[i], m.mt))"
    per_chain = (
        f"transform(chains, (c, i) -> CASE WHEN _muts[c] IS NULL OR lower(trim(_muts[c])) IN {_EMPTY} "
        f"THEN cast(array() AS array<string>) ELSE {shifted} END)"
    )
    text = F.expr(f"CASE WHEN _muts IS NULL THEN coalesce(_global, '') ELSE array_join(flatten({per_chain}), '{SEPARATOR}') END")
    return rows.select(*[F.col(c) for c in df.columns], "wt_concat", text.alias("mutant_global"))


def pick_heavy_light(chains: str) -> Column:
    """Heavy and light chain ids of a map column; the last matching key wins."""
    def last(names: tuple[str, ...]) -> str:
        listed = ", ".join(f"'{n}'" for n in names)
        return f"try_element_at(filter(map_keys({chains}), k -> k IN ({listed})), -1)"
    return F.expr(f"named_struct('heavy', {last(HEAVY_NAMES)}, 'light', {last(LIGHT_NAMES)})")


def saturate(df: DataFrame, seq: str, positions: str, taken: str | None = None, index_base: int = 1) -> DataFrame:
    """Every single substitution at the listed 0-based positions (C11).

    Adds ``position``, ``mutation`` (``H<pos><old>><new>``) and ``mutated``;
    positions in the array column ``taken`` are skipped.
    """
    site = f"filter({positions}, p -> NOT array_contains({taken}, p))" if taken else positions
    rows = df.select("*", F.explode(F.expr(site)).alias("position"))
    rows = rows.select("*", F.expr(f"substring({seq}, position + 1, 1)").alias("_old"))
    rows = rows.select("*", F.explode(F.expr(f"filter(split('{RESIDUES}', ''), a -> a <> '' AND a <> _old)")).alias("_new"))
    return rows.select(
        *[F.col(c) for c in df.columns], "position",
        F.expr(f"concat('H', position + {index_base}, _old, '>', _new)").alias("mutation"),
        F.expr(f"overlay({seq} PLACING _new FROM position + 1 FOR 1)").alias("mutated"),
    )


__all__ = ["clean_assay", "chain_map", "chain_order", "focus_chains", "concat_chains", "globalize_mutations",
           "pick_heavy_light", "saturate", "mutation_problem"]

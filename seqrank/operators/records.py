"""Antibody records, candidate search and ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import with_position, with_row_index
from ..functions.text import END_TERMINAL, LINKER, START_TERMINAL, clean_sequence, serialize_record
from ..session import checkpoint_dir
from .clean import find_column, first_rows
from .metrics import to_number
from .mutations import saturate

# Known spellings of record columns, in order of preference.
EPITOPE = ("epitope", "epitope_region", "epitope_sequence", "antigen_epitope", "antigen_sequence")
HEAVY = ("vh", "h", "heavy", "heavy_chain", "heavy_sequence", "heavy_chain_variable", "heavy_variable")
LIGHT = ("vl", "l", "light", "light_chain", "light_sequence", "light_chain_variable", "light_variable")
RECORD_ID = ("id", "record_id", "name", "sequence_id", "antibody_id")
TARGET = ("target", "antigen", "antigen_target", "target_name")
ACTIVITY = ("subset", "dataset", "activity", "active", "is_active", "label", "status", "elisa_status", "split")
EC50 = ("EC50(ng/ML)", "ec50", "ec50_ng_ml", "ec50_ng_per_ml")
RANGE_LIST = ("hcdr_ranges", "hcdrs", "cdrh_ranges", "heavy_cdr_ranges", "h_cdr_ranges")
CDR = ("hcdr{0}", "h_cdr{0}", "cdrh{0}", "cdr_h{0}")
CDR_START = ("hcdr{0}_start", "h_cdr{0}_start", "cdrh{0}_start", "cdr_h{0}_start", "heavy_cdr{0}_start")
CDR_END = ("hcdr{0}_end", "h_cdr{0}_end", "cdrh{0}_end", "cdr_h{0}_end", "heavy_cdr{0}_end")
# Status words of active records. A collection with a status word
# of its own passes its list.
ACTIVE_VALUES = ("active", "positive", "binder", "true", "1", "yes")

_RANGES = "array<struct<start:int,end:int>>"


def _text(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.replace(F.to_json(c), F.lit('"'), F.lit(""))
    return c.cast("string")


def filter_active(df: DataFrame, status: str | None, values: Sequence[str] = ACTIVE_VALUES) -> DataFrame:
    """Rows whose status is one of ``values`` in any case."""
    return df if status is None else df.filter(F.lower(F.trim(F.coalesce(_text(df, status), F.lit("")))).isin(*[v.lower() for v in values]))


def filter_potency(df: DataFrame, ec50: str, cap: float, skip_invalid: bool = True) -> DataFrame:
    """Rows with a numeric potency at or below the cap.

    Rows without a potency are dropped; so is text that is no number, unless
    ``skip_invalid=False``, where it raises.
    """
    text = F.trim(F.col(f"`{ec50}`").cast("string"))
    value = to_number(text)
    if not skip_invalid:
        broken = (text != "") & text.try_cast("double").isNull()
        value = F.when(broken, F.raise_error(F.concat(F.lit("potency is no number: "), text)).cast("double")).otherwise(value)
    return df.filter(value <= cap)


def filter_target(df: DataFrame, target: str, value: str) -> DataFrame:
    """Rows of one target, ignoring case."""
    return df.filter(F.upper(F.col(target)) == value.upper())


def _one_range(text: str) -> str:
    # Fixed value: the input form of a range.
    pattern = r"^\\s*([0-9]+)\\s*(?:-|:|[.][.])\\s*([0-9]+)\\s*$"
    return (
        f"CASE WHEN {text} rlike '{pattern}' THEN named_struct('start', cast(regexp_extract({text}, '{pattern}', 1) AS int), "
        f"'end', cast(regexp_extract({text}, '{pattern}', 2) AS int)) END"
    )


def cdr_ranges(df: DataFrame, vh: str, base: int = 1, out: str = "hcdr_ranges") -> DataFrame:
    """Heavy CDR ranges as 0-based half-open pairs; null when a row is invalid.

    Sources in order: a range-list column; one range or start/end columns per
    CDR; the CDR text located in the heavy chain, searched from the end of the
    previous one first. ``vh`` is the cleaned heavy chain.
    """
    cols = df.columns
    listed = find_column(cols, RANGE_LIST, ignore_case=True)
    single = {i: find_column(cols, [c.format(i) for c in CDR], True) for i in (1, 2, 3)}
    starts = {i: find_column(cols, [c.format(i) for c in CDR_START], True) for i in (1, 2, 3)}
    ends = {i: find_column(cols, [c.format(i) for c in CDR_END], True) for i in (1, 2, 3)}
    rows, none = df, f"cast(array() AS {_RANGES})"
    valid = (
        f"forall(_raw, r -> r IS NOT NULL AND r.start - {base} >= 0 AND r.end >= r.start AND r.end - {base} + 1 <= length({vh}))"
    )
    shifted = f"CASE WHEN {valid} THEN transform(_raw, r -> named_struct('start', r.start - {base}, 'end', r.end - {base} + 1)) END"
    if listed:
        rows = rows.withColumn("_list", F.trim(F.coalesce(_text(df, listed), F.lit(""))))
        json = "transform(from_json(_list, 'array<array<int>>'), p -> named_struct('start', p[0], 'end', p[1]))"
        parts = f"transform(filter(split(_list, '[;|,]'), p -> trim(p) <> ''), p -> {_one_range('p')})"
        rows = rows.withColumn("_raw", F.expr(f"CASE WHEN _list = '' THEN {none} WHEN _list LIKE '[%' THEN coalesce({json}, array(cast(NULL AS struct<start:int,end:int>))) ELSE {parts} END"))
        return rows.withColumn(out, F.expr(shifted)).drop("_list", "_raw")
    pieces = []
    for i in (1, 2, 3):
        cell = F.coalesce(_text(df, single[i]), F.lit("")) if single[i] else F.lit("")
        rows = rows.withColumn(f"_cdr{i}", cell)
        bounds = none
        if starts[i] and ends[i]:
            lo, hi = f"nullif(trim(cast(`{starts[i]}` AS string)), '')", f"nullif(trim(cast(`{ends[i]}` AS string)), '')"
            bounds = f"CASE WHEN {lo} IS NULL OR {hi} IS NULL THEN {none} ELSE array(named_struct('start', try_cast({lo} AS int), 'end', try_cast({hi} AS int))) END"
        pieces.append(f"CASE WHEN _cdr{i} = '' THEN {bounds} WHEN _cdr{i} rlike '[0-9]' THEN array({_one_range(f'_cdr{i}')}) ELSE {none} END")
    rows = rows.withColumn("_raw", F.expr(f"concat({', '.join(pieces)})"))
    # Located CDR text: a fold over the three texts with the search start.
    for i in (1, 2, 3):
        rows = rows.withColumn(f"_seq{i}", F.when(F.col(f"_cdr{i}") != "", F.coalesce(clean_sequence(F.col(f"_cdr{i}"), "strict"), F.lit("?"))).otherwise(""))
    at = f"if(locate(c, {vh}, a.from + 1) > 0, locate(c, {vh}, a.from + 1), locate(c, {vh}))"
    step = (
        f"CASE WHEN c = '' OR NOT a.ok THEN a WHEN {at} = 0 THEN named_struct('from', a.from, 'ranges', a.ranges, 'ok', false) "
        f"ELSE named_struct('from', {at} - 1 + length(c), 'ranges', array_append(a.ranges, named_struct('start', {at} - 1, 'end', {at} - 1 + length(c))), 'ok', true) END"
    )
    rows = rows.withColumn("_found", F.expr(f"aggregate(array(_seq1, _seq2, _seq3), named_struct('from', 0, 'ranges', {none}, 'ok', true), (a, c) -> {step})"))
    rows = rows.withColumn(out, F.expr(f"CASE WHEN size(_raw) > 0 THEN {shifted} WHEN _found.ok THEN _found.ranges END"))
    return rows.drop("_raw", "_found", *[f"_cdr{i}" for i in (1, 2, 3)], *[f"_seq{i}" for i in (1, 2, 3)])


def cdr_positions(ranges: str) -> Column:
    """Distinct 0-based positions of the ranges, in order."""
    return F.expr(f"array_distinct(flatten(transform({ranges}, r -> sequence(r.start, r.end - 1))))")


def load_records(
    df: DataFrame, active_only: bool = True, active_values: Sequence[str] = ACTIVE_VALUES, max_ec50: float | None = None,
    cdr_base: int = 1, skip_invalid: bool = True, raw_row: bool = False, row_idx: str | None = None,
) -> DataFrame:
    """Records from a raw table (J1): id, target, cleaned chains, CDR ranges, serialized text.

    Invalid rows are skipped or raise. The default id is ``record_<row index>``.
    """
    cols = df.columns
    names = {k: find_column(cols, a, True) for k, a in {
        "epitope": EPITOPE, "vh": HEAVY, "vl": LIGHT, "id": RECORD_ID, "target": TARGET, "status": ACTIVITY, "ec50": EC50}.items()}
    absent = [k for k in ("epitope", "vh", "vl") if names[k] is None]
    if absent:
        raise ValueError(f"missing record columns: {', '.join(absent)}")
    rows = df if row_idx else with_row_index(df, name="_row")
    idx = row_idx or "_row"
    if active_only:
        rows = filter_active(rows, names["status"], active_values)
    if max_ec50 is not None:
        if names["ec50"] is None:
            raise ValueError("a potency cap needs a potency column")
        rows = filter_potency(rows, names["ec50"], max_ec50, skip_invalid)
    blank = F.lit("")
    given = F.trim(F.coalesce(_text(df, names["id"]), blank)) if names["id"] else blank
    rows = rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("_vh", "_vl", "_epitope")],
        F.coalesce(F.nullif(given, blank), F.format_string("record_%05d", F.col(idx))).alias("_id"),
        (F.trim(F.coalesce(_text(df, names["target"]), blank)) if names["target"] else blank).alias("_target"),
        *[clean_sequence(_text(df, names[k]), "strict").alias(f"_{k}") for k in ("epitope", "vh", "vl")],
    )
    rows = cdr_ranges(rows, "_vh", cdr_base, "_ranges")
    good = F.col("_epitope").isNotNull() & F.col("_vh").isNotNull() & F.col("_vl").isNotNull() & F.col("_ranges").isNotNull()
    if skip_invalid:
        rows = rows.filter(good)
    else:
        rows = rows.withColumn("_id", F.when(good, F.col("_id")).otherwise(F.raise_error(F.concat(F.lit("invalid record "), F.col("_id")))))
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[_text(df, c) for c in cols])) if raw_row else F.create_map().cast("map<string,string>")
    return rows.select(
        F.col(idx).alias("row_idx"), F.col("_id").alias("record_id"), F.col("_target").alias("target"), F.col("_epitope").alias("epitope"),
        F.col("_vh").alias("vh"), F.col("_vl").alias("vl"), F.col("_ranges").alias("hcdr_ranges"),
        serialize_record(F.col("_epitope"), F.col("_vh"), F.col("_vl")).alias("serialized"), raw.alias("row"))


def drop_long(df: DataFrame, text: str, limit: int, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records within the length limit and the number dropped."""
    fits = F.length(text) <= limit
    if fail:
        checked = df.withColumn(text, F.when(fits, F.col(text)).otherwise(F.raise_error(F.lit(f"record is longer than {limit}"))))
        return checked, df.agg(F.lit(0).cast("long").alias("dropped"))
    return df.filter(fits), df.agg(F.count_if(~fits).alias("dropped"))


# ------------------------------------------------------------------ candidate search

_CANDIDATE = ("seed_id", "target", "epitope", "vh", "vl", "hcdr_ranges", "mutation_positions", "mutations")


def as_candidates(records: DataFrame, order: str = "row_idx") -> DataFrame:
    """Unmutated parents from records; ``parent_rank`` keeps the record order."""
    return records.select(
        F.col("record_id").alias("seed_id"), "target", "epitope", "vh", "vl", "hcdr_ranges",
        F.expr("cast(array() AS array<int>)").alias("mutation_positions"),
        F.expr("cast(array() AS array<string>)").alias("mutations"),
        F.col(order).cast("long").alias("parent_rank"))


def enumerate_children(parents: DataFrame, index_base: int = 1) -> DataFrame:
    """All single substitutions of all parents, the first parent of a text wins.

    A child differs from its parent in one letter, so two parents with a child in common differ in two at
    most, and of three parts of their texts one is equal. Only children of parents that share a part with
    another one are compared; the children of one parent differ from each other.
    """
    text = F.concat(F.lit(START_TERMINAL), "epitope", F.lit(LINKER), "vh", F.lit(LINKER), "vl", F.lit(END_TERMINAL))
    spots = parents.withColumn("_spots", cdr_positions("hcdr_ranges")).withColumn("_id", F.xxhash64(text))
    thirds = "array(left(s, length(s) div 3), substring(s, length(s) div 3 + 1, length(s) div 3), substring(s, 2 * (length(s) div 3) + 1))"
    parts = parents.select(text.alias("s")).filter("s IS NOT NULL").select(
        F.xxhash64("s").alias("_id"), F.expr(f"explode(transform({thirds}, (x, i) -> xxhash64(i, length(s), x)))").alias("part"))
    seen = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part")
    near = parts.join(seen, "part").select("_id").distinct().withColumn("_near", F.lit(True))
    # Texts that are null, and spots outside the chain, are compared too.
    odd = text.isNull() | F.expr("exists(_spots, p -> p < 0 OR p >= length(vh))")
    spots = spots.join(near, "_id", "left").withColumn("_near", F.coalesce("_near", odd, F.lit(True))).drop("_id")
    near, alone = (_children(spots.filter(c).drop("_near"), index_base) for c in ("_near", "NOT _near"))
    return first_rows(near, ["serialized"], [F.col("parent_rank"), F.col("_spot"), F.col("_aa")]).unionByName(alone)


def _children(spots: DataFrame, index_base: int) -> DataFrame:
    kids = saturate(spots, "vh", "_spots", "mutation_positions", index_base)
    kids = kids.select(
        "seed_id", "target", "epitope", F.col("mutated").alias("vh"), "vl", "hcdr_ranges",
        F.array_append("mutation_positions", F.col("position")).alias("mutation_positions"),
        F.array_append("mutations", F.col("mutation")).alias("mutations"),
        "parent_rank", F.expr("array_position(_spots, position)").alias("_spot"), F.right("mutation", F.lit(1)).alias("_aa"))
    # Parents are clean already, so the record text is a plain concatenation.
    parts = [F.lit(START_TERMINAL), "epitope", F.lit(LINKER), "vh", F.lit(LINKER), "vl", F.lit(END_TERMINAL)]
    return kids.withColumn("serialized", F.concat(*parts))


def beam_step(parents: DataFrame, scorer: Callable[[DataFrame], DataFrame], keep: int, index_base: int = 1) -> DataFrame:
    """Enumerate, dedupe, score, keep the best (J7). ``scorer`` adds ``score``.

    Parents are written first and the rows kept at the end, so records are located, and children
    made and scored, once however often they are read.
    """
    checkpoint_dir(parents.sparkSession)
    return _step(parents.checkpoint(), scorer, keep, index_base)


def _step(parents: DataFrame, scorer: Callable[[DataFrame], DataFrame], keep: int, index_base: int) -> DataFrame:
    scored = scorer(enumerate_children(parents, index_base))
    return scored.orderBy(F.col("score").desc(), "parent_rank", "_spot", "_aa").limit(keep).checkpoint()


def beam_search(
    records: DataFrame, scorer: Callable[[DataFrame], DataFrame], rounds: int = 3, beam: int = 50, final: int = 200, index_base: int = 1
) -> DataFrame:
    """Rounds of :func:`beam_step`; best ``final`` of everything seen.

    A candidate in the overall best ``final`` is among the best ``final`` of
    its own round, so each round keeps max(beam, final) rows and nothing else
    is carried; every round is cut by a checkpoint.
    """
    checkpoint_dir(records.sparkSession)
    parents, seen = as_candidates(records).checkpoint(), None
    if not parents.filter("hcdr_ranges IS NULL OR size(hcdr_ranges) = 0").isEmpty():
        raise ValueError("records without CDR ranges")
    for r in range(1, rounds + 1):
        best = _step(parents, scorer, max(beam, final), index_base)
        kept = _placed(best).withColumn("round", F.lit(r)).checkpoint()
        if kept.isEmpty():
            break
        seen = kept if seen is None else seen.unionByName(kept)
        parents = kept.filter(F.col("place") < beam).select(*_CANDIDATE, F.col("place").alias("parent_rank"))
    if seen is None:
        raise ValueError("no candidates: records without CDR ranges")
    unique = first_rows(seen, ["serialized"], [F.col("round")])
    return unique.orderBy(F.col("score").desc(), "round", "place").limit(final).select(*_CANDIDATE, "serialized", "score", "round", "place")


def _placed(best: DataFrame) -> DataFrame:
    """0-based place by score, then generation order."""
    keyed = best.withColumn("_neg", -F.col("score"))
    return with_position(keyed, [], ["_neg", "parent_rank", "_spot", "_aa"], "place").drop("_neg", "parent_rank", "_spot", "_aa")


def candidate_table(cands: DataFrame, redact: bool = True) -> DataFrame:
    """Ranked table with text columns (J9); seeds get aliases by first appearance."""
    keyed = cands.withColumn("_neg", -F.col("score"))
    ranked = with_position(keyed, [], ["_neg", "round", "place"], "_r").withColumn("rank", F.col("_r") + 1)
    if redact:
        first = ranked.groupBy("seed_id").agg(F.min("rank").alias("_first"))
        alias = with_position(first, [], ["_first"], "_i").select("seed_id", F.format_string("seed_%05d", F.col("_i") + 1).alias("_alias"))
        ranked = ranked.join(alias, "seed_id").withColumn("seed_id", F.col("_alias")).withColumn("target", F.lit("redacted"))
    return ranked.select(
        "rank", "seed_id", "target", F.size("mutations").alias("mutation_count"), F.array_join("mutations", ";").alias("mutations"),
        F.format_string("%.8f", "score").alias("log_likelihood"), "epitope", "vh", "vl", "serialized")


# ------------------------------------------------------------------ predicted structures

def metric_map(c: str) -> Column:
    """JSON object text as a map with lower-case keys; of keys that differ in case the last one wins."""
    entries = f"map_entries(from_json({c}, 'map<string,string>'))"
    last = f"filter({entries}, (e, i) -> NOT exists(slice({entries}, i + 2, size({entries})), o -> lower(o.key) = lower(e.key)))"
    return F.expr(f"map_from_entries(transform({last}, e -> struct(lower(e.key) AS key, e.value AS value)))")


def _metric(m: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"{m}['{n}']" for n in names) + ")"


def ranking_score(m: str) -> Column:
    """Given score, else the weighted combination; null when a part is missing."""
    clash = _metric(m, "has_clash", "hasclash")
    flag = f"CASE WHEN {clash} IS NULL THEN NULL WHEN lower({clash}) IN ('false', '0', '0.0', '') THEN 0D ELSE 1D END"
    # Weights of the combined score.
    combined = (
        f"0.8D * try_cast({_metric(m, 'iptm')} AS double) + 0.2D * try_cast({_metric(m, 'ptm')} AS double) "
        f"+ 0.5D * try_cast({_metric(m, 'fraction_disordered', 'fractiondisordered')} AS double) - 100D * ({flag})"
    )
    return F.expr(f"CASE WHEN {_metric(m, 'ranking_score', 'rankingscore')} IS NOT NULL THEN try_cast({_metric(m, 'ranking_score', 'rankingscore')} AS double) ELSE {combined} END")


def candidate_id(path: str, m: str, mode: str = "parent", regex: str | None = None) -> Column:
    """Candidate id from the folder, the JSON name or the file stem."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")
    if mode == "name":
        value = F.coalesce(F.nullif(F.expr(f"{m}['name']"), F.lit("")), stem)
    elif mode == "file":
        value = stem
    elif mode == "parent":
        value = F.coalesce(F.try_element_at(F.split(F.col(path), "/"), F.lit(-2)), F.lit(""))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if regex is None:
        return value
    import re

    group = 1 if re.compile(regex).groups else 0
    return F.when(value.rlike(regex), F.regexp_extract(value, regex, group)).otherwise(value)


def best_per_candidate(files: DataFrame, path: str = "path", content: str = "value", mode: str = "parent", regex: str | None = None) -> DataFrame:
    """Best prediction per candidate by score, then interface score, then path."""
    rows = files.select(F.col(path).alias("prediction_file"), metric_map(content).alias("_m")).filter("_m IS NOT NULL")
    scored = rows.select(
        candidate_id("prediction_file", "_m", mode, regex).alias("candidate_id"), "prediction_file", ranking_score("_m").alias("ranking_score"),
        F.expr("coalesce(try_cast(_m['iptm'] AS double), 0D)").alias("iptm"), F.expr("coalesce(try_cast(_m['ptm'] AS double), 0D)").alias("ptm"))
    scored = scored.filter("ranking_score IS NOT NULL")
    return first_rows(scored, ["candidate_id"], [-F.col("ranking_score"), -F.col("iptm"), F.col("prediction_file")])


def top_ranked(best: DataFrame, n: int = 20) -> DataFrame:
    """Global order with 1-based rank, the best ``n`` or all."""
    rows = best.orderBy(F.desc("ranking_score"), F.desc("iptm"), "candidate_id").limit(n) if n else best
    keyed = rows.withColumns({"_a": -F.col("ranking_score"), "_b": -F.col("iptm")})
    ranked = with_position(keyed, [], ["_a", "_b", "candidate_id"], "_r")
    return ranked.select((F.col("_r") + 1).alias("rank"), "candidate_id", "ranking_score", "iptm", "ptm", "prediction_file")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same rows, or an error when there are none."""
    if df.isEmpty():
        raise ValueError(message)
    return df

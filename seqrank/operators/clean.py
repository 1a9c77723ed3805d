"""Schema alignment, label columns and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import clean_sequence, join_chains, split_antibody
from .metrics import to_number

# Known spellings of the canonical training columns.
TRAINING_ALIASES = {
    "Antigen": ("Antigen", "antigen", "antigen_sequence", "Antigen_Sequence", "Ag_seq", "Ag_sequence", "Ag_Seq"),
    "HC": ("HC", "heavy_chain", "heavy", "Ab_heavy_chain_seq", "VH_abnum", "Ab_H_seq", "VH"),
    "LC": ("LC", "light_chain", "light", "Ab_light_chain_seq", "VL_abnum", "Ab_L_seq", "VL"),
}
ANTIBODY_ALIASES = ("antibody_sequence", "Antibody", "antibody")
DDG_ALIASES = ("ddG", "ddG(kcal/mol)", "ddg", "DDG", "DeltaDeltaG")

# Substrings that mark a data collection, and where to look.
DATASET_MARKS = {
    "dms": ("(?i)bindinggym", ("dataset_id", "Ab_name")),
    "ddg_native": ("(?i)ab-?bind", ("Ab_name", "entry_id")),
    "repeat_complexes": ("(?i)skempi", ("Ab_name",)),
    "neutralisation": ("(?i)abcov", ("Ab_name",)),
}


def find_column(columns: Sequence[str], aliases: Sequence[str], ignore_case: bool = False) -> str | None:
    """First alias that is a column; optionally in any case."""
    lowered = {c.lower(): c for c in reversed(columns)}
    for a in aliases:
        if ignore_case:
            if a.lower() in lowered:
                return lowered[a.lower()]
        elif a in columns:
            return a
        elif a.lower() in columns:
            return a.lower()
    return None


def resolve_columns(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], ignore_case: bool = False, fill_missing: str | None = None
) -> DataFrame:
    """Rename the first matching alias to its canonical name (B1)."""
    renames, missing = {}, []
    for canonical, names in aliases.items():
        found = find_column(df.columns, names, ignore_case)
        if found is None:
            missing.append(canonical)
        elif found != canonical:
            renames[found] = canonical
    out = df.withColumnsRenamed(renames)
    if missing and fill_missing is None:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out.withColumns({m: F.lit(fill_missing) for m in missing}) if missing else out


def require_columns(df: DataFrame, choices: Sequence[str] = ("DMS_score", "Affinity_Kd_nM"), also: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Pick the first available label column and drop incomplete rows."""
    label = next((c for c in choices if c in df.columns), None)
    if label is None:
        raise ValueError(f"need one of: {', '.join(choices)}")
    absent = [c for c in also if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.dropna(subset=[label, *also]), label


def infer_score_column(columns: Sequence[str], label: str = "DMS_score") -> str | None:
    """The only ``*_score`` column besides the label, else None."""
    found = [c for c in columns if c.endswith("_score") and c != label]
    return found[0] if len(found) == 1 else None


def only_score(columns: Column, label: str = "DMS_score") -> Column:
    """The rule of :func:`infer_score_column` for an array column of names."""
    found = F.filter(columns, lambda c: F.endswith(c, F.lit("_score")) & (c != F.lit(label)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def affinity_source(df: DataFrame, sources: Sequence[tuple[str, str, float]] = L.AFFINITY_SOURCES) -> tuple[str, str, float] | None:
    """The candidate column with most numeric values (B7); one aggregate row decides."""
    present = [s for s in sources if s[0] in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count(to_number(F.col(f"`{c}`"))).alias(f"n{i}") for i, (c, _, _) in enumerate(present)]).first()
    best = max(range(len(present)), key=lambda i: (counts[i], -i))
    return present[best] if counts[best] > 0 else None


def pick_affinity_source(df: DataFrame, sources: Sequence[tuple[str, str, float]] = L.AFFINITY_SOURCES) -> DataFrame:
    """Add ``KD(M)`` and ``affinity_source_kind`` from the best affinity column."""
    best = affinity_source(df, sources)
    if best is None:
        return df.withColumns({"KD(M)": F.lit(None).cast("double"), "affinity_source_kind": F.lit("unknown")})
    column, kind, factor = best
    return df.withColumns({"KD(M)": to_number(F.col(f"`{column}`")) * F.lit(factor), "affinity_source_kind": F.lit(kind)})


def standardize_for_training(df: DataFrame, target: str = "pkd") -> DataFrame:
    """Canonical chains, antigen and ``affinity`` with source metadata columns.

    No row is dropped: split files address rows by position.
    """
    wanted = target.lower()
    kind: Column = F.lit("unknown")
    direct: Column = F.lit(False)
    if wanted == "pkd":
        if "KD(M)" not in df.columns and affinity_source(df) is not None:
            df = pick_affinity_source(df)
            kind = F.col("affinity_source_kind")
        elif "KD(M)" in df.columns or "pKd" in df.columns:
            kind = F.lit("molar_direct")
        else:
            raise ValueError("no KD or pKd column for the pkd target")
        source = L.kd_to_label(to_number(F.col("KD(M)"))) if "KD(M)" in df.columns else F.col("pKd")
        direct = kind == "molar_direct"
    elif wanted == "ddg":
        name = find_column(df.columns, DDG_ALIASES)
        if name is None:
            raise ValueError("no ddG column for the ddg target")
        kind, source = F.lit("ddg_native"), F.col(f"`{name}`")
    else:
        name = find_column(df.columns, (target,))
        if name is None:
            raise ValueError(f"target column {target!r} not found")
        source = F.col(f"`{name}`")
    df = df.withColumns({"affinity": to_number(source), "affinity_source_kind": kind, "kd_metrics_enabled": direct})
    df = resolve_columns(df, {"Antigen": TRAINING_ALIASES["Antigen"]})
    chains = {c: find_column(df.columns, TRAINING_ALIASES[c]) for c in ("HC", "LC")}
    if None in chains.values():
        joined = find_column(df.columns, ANTIBODY_ALIASES)
        if joined is None:
            raise ValueError("neither chains nor a combined antibody column found")
        both = split_antibody(F.col(joined))
        df = df.withColumns({"HC": both["hc"], "LC": both["lc"]})
    else:
        df = df.withColumnsRenamed({v: k for k, v in chains.items() if v != k})
    df = df.withColumns({c: clean_sequence(F.col(c), "residues") for c in ("HC", "LC", "Antigen")})
    return df.withColumn("Antibody", join_chains(F.col("HC"), F.col("LC"), "bar"))


def detect_dataset_kind(
    df: DataFrame, antigen: str | None = "Ag_name", path: str = "",
    marks: Mapping[str, tuple[str, Sequence[str]]] = DATASET_MARKS,
) -> DataFrame:
    """One row of any-row flags and the share of the most frequent antigen."""
    flags = {}
    for name, (pattern, columns) in marks.items():
        hit = F.lit(path).rlike(pattern)
        for c in columns:
            if c in df.columns:
                hit = hit | F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))
        flags[f"is_{name}"] = hit
    if antigen is None or antigen not in df.columns:
        return df.agg(*[F.coalesce(F.bool_or(h), F.lit(False)).alias(n) for n, h in flags.items()])
    per = df.groupBy(antigen).agg(F.count(antigen).alias("_n"), F.count(F.lit(1)).alias("_all"), *[F.bool_or(h).alias(n) for n, h in flags.items()])
    share = F.max("_n") / F.sum("_all")
    return per.agg(
        *[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags],
        share.alias("dominant_share"),
        (share > 0.8).alias("use_random_split"),
    )


def filter_affinity(
    df: DataFrame, kd: str, kd_max: float | None = None, censored: str | None = None, tags: Mapping[str, str] | None = None
) -> DataFrame:
    """Keep positive finite KD values, optionally capped and uncensored."""
    out = df
    if censored is not None:
        out = out.filter(~F.coalesce(F.trim(F.col(f"`{censored}`")).startswith("<"), F.lit(False)))
    out = out.withColumn(kd, to_number(F.col(f"`{kd}`"))).filter(F.col(f"`{kd}`") > 0)
    if kd_max is not None:
        out = out.filter(F.col(f"`{kd}`") <= kd_max)
    return out.withColumns({k: F.lit(v) for k, v in tags.items()}) if tags else out


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key by ``order``; partial aggregates shrink hot keys before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def drop_duplicate_complexes(df: DataFrame, row_idx: str = "row_idx", keys: Sequence[str] = ("HC", "LC", "Antigen"), exempt: bool = False) -> DataFrame:
    """Keep the first row per complex unless the data kind is exempt."""
    return df if exempt else first_rows(df, keys, [F.col(row_idx)])


def quarantine_all_zero(df: DataFrame, file: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of files whose value is 0.0 everywhere, the other rows, and file counts."""
    zero = F.coalesce(F.trim(F.col(value).cast("string")).try_cast("double") == 0.0, F.lit(False))
    flags = df.groupBy(file).agg(F.bool_and(zero).alias("_zero"))
    # A hash table of the files found, so that a task doesn't sort its rows.
    zeros = flags.filter("_zero").select(file).hint("shuffle_hash")
    moved = df.join(zeros, file, "left_semi")
    kept = df.join(zeros, file, "left_anti")
    return moved, kept, flags.agg(F.count(F.lit(1)).alias("checked"), F.count_if("_zero").alias("moved"))

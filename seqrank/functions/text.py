"""String expressions for sequences, chains, model names and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The linker between chains, the record terminals and the
# antibody length above which a lone heavy chain counts as single-chain.
LINKER = "GGGGSGGGGSGGGGS"
START_TERMINAL, END_TERMINAL = "1", "2"
SINGLE_CHAIN_LENGTH = 250
# Text that stands for "no mutation".
EMPTY_WORDS = ("", "nan", "none", "<na>")


def clean_sequence(c: Column, mode: str = "trim") -> Column:
    """Normalise a sequence.

    ``trim``     whitespace removed, upper case, missing and ``nan`` become ``''``
    ``letters``  letters only, upper case, missing becomes ``''``
    ``residues`` A-Z only, rare residues (U, Z, O, B) become X, empty becomes null
    ``strict``   whitespace and ``- _ .`` removed; null when empty or not A-Z only
    """
    text = F.coalesce(c.cast("string"), F.lit(""))
    if mode == "trim":
        out = F.upper(F.regexp_replace(text, r"\s+", ""))
        return F.when(out == "NAN", "").otherwise(out)
    if mode == "letters":
        return F.upper(F.regexp_replace(text, r"[^\p{L}]", ""))
    if mode == "residues":
        out = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z]", ""), "[UZOB]", "X")
        return F.nullif(out, F.lit(""))
    if mode == "strict":
        out = F.upper(F.regexp_replace(text, r"[\s\-_.]", ""))
        return F.when(out.rlike("^[A-IK-Z]+$"), out)
    raise ValueError(f"unknown mode {mode!r}")


def is_empty_mutation(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*EMPTY_WORDS)


def split_antibody(c: Column) -> Column:
    """``heavy|light`` text to a struct; text without a bar is a heavy chain."""
    parts = F.split(c, r"\|", 2)
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("hc"), F.try_element_at(parts, F.lit(2)).alias("lc"))


def join_chains(hc: Column, lc: Column, style: str = "linked", linker: str = LINKER) -> Column:
    """Antibody text from two chains.

    ``linked``  linker only when both chains exist, else the one that does
    ``always``  linker unconditionally
    ``bar``     ``heavy|light`` with missing chains empty
    """
    h, l = F.coalesce(hc, F.lit("")), F.coalesce(lc, F.lit(""))
    if style == "linked":
        # A long lone heavy chain is single-chain text and stays as it is, which
        # is also what a short lone heavy chain does.
        return F.when((h != "") & (l != ""), F.concat(h, F.lit(linker), l)).otherwise(F.concat(h, l))
    if style == "always":
        return F.concat(h, F.lit(linker), l)
    if style == "bar":
        return F.concat(h, F.lit("|"), l)
    raise ValueError(f"unknown style {style!r}")


def safe_name(c: Column) -> Column:
    """File-safe text: runs of other characters become one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def safe_token(c: Column) -> Column:
    """Letters and digits with single inner underscores; ``unknown`` when nothing is left."""
    token = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("unknown"))


def model_tag(c: Column) -> Column:
    """File-safe model id with eight hexadecimal digits of its SHA-256."""
    raw = F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown_model"))
    plain = F.regexp_replace(F.replace(raw, F.lit("/"), F.lit("__")), "[^A-Za-z0-9._-]", "_")
    return F.concat(plain, F.lit("__"), F.substring(F.sha2(raw, 256), 1, 8))


def canonical_model(c: Column, unified: tuple[str, ...] = ("MAGE",)) -> Column:
    """Absolute paths become ``custom/<parent>_<name>``; other names stay.

    A path that holds one of the ``unified`` names (upper or lower case) maps
    to ``custom/<name>``.
    """
    name = F.trim(c)
    parts = F.split(name, "/")
    local = F.concat(F.lit("custom/"), F.element_at(parts, -2), F.lit("_"), F.element_at(parts, -1))
    out = F.when(~name.startswith("/"), name)
    for u in unified:
        out = out.when(name.contains(u) | name.contains(u.lower()), F.lit(f"custom/{u}"))
    return out.otherwise(local)


def model_key(c: Column) -> Column:
    """Canonical and file-safe model key."""
    return safe_name(canonical_model(c))


def task_key(path: Column) -> Column:
    """Base name of a path without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def serialize_record(epitope: Column, vh: Column, vl: Column, linker: str = LINKER) -> Column:
    """``1 epitope LINKER vh LINKER vl 2``; null when a part is invalid."""
    e, h, l = (clean_sequence(c, "strict") for c in (epitope, vh, vl))
    return F.concat(F.lit(START_TERMINAL), e, F.lit(linker), h, F.lit(linker), l, F.lit(END_TERMINAL))


def split_serialized(c: Column, linker: str = LINKER) -> Column:
    """Inverse of :func:`serialize_record`; null unless there are exactly two linkers."""
    text = F.trim(c)
    parts = F.split(F.substring(text, F.lit(2), F.length(text) - 2), linker)
    cleaned = [clean_sequence(F.try_element_at(parts, F.lit(i)), "strict") for i in (1, 2, 3)]
    whole = text.startswith(START_TERMINAL) & text.endswith(END_TERMINAL) & (F.size(parts) == 3)
    for x in cleaned:
        whole = whole & x.isNotNull()
    return F.when(whole, F.struct(*[x.alias(n) for x, n in zip(cleaned, ("epitope", "vh", "vl"), strict=True)]))


def truncate_at_terminal(c: Column, terminals: tuple[str, ...] = (START_TERMINAL, END_TERMINAL)) -> Column:
    """Cut after the first terminal that is not the first character."""
    mark = "[" + "".join("\\" + t if t in "\\]^-" else t for t in terminals) + "]"
    return F.regexp_replace(c, f"(?s)^(..*?{mark}).*$", "$1")


def structure_tokens(seq: Column, structure: Column, confidence: Column, minimum: float = 70.0) -> Column:
    """Residue and lower-case structure letter interleaved; unsure letters become ``#``."""
    def tokens(row: Column) -> Column:
        seq, structure, confidence = row["seq"], row["structure"], row["confidence"]
        letters = F.transform(
            F.sequence(F.lit(1), F.least(F.length(seq), F.length(structure))),
            lambda i: F.concat(
                F.substring(seq, i, F.lit(1)),
                F.when(F.coalesce(F.get(confidence, i - 1), F.lit(minimum)) < minimum, "#").otherwise(F.lower(F.substring(structure, i, F.lit(1)))),
            ),
        )
        return F.when(F.least(F.length(seq), F.length(structure)) == 0, "").otherwise(F.array_join(letters, ""))

    # Bound to one struct, the inputs are computed once per row and not once per letter.
    row = F.struct(seq.alias("seq"), structure.alias("structure"), confidence.alias("confidence"))
    return F.get(F.transform(F.array(row), tokens), F.lit(0))

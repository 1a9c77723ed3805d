"""Mutation strings as arrays of ``(wt, pos, mt)`` structs.

All functions take SQL text of a column (a name or an expression) and return a
``Column``; everything stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard residues and the separator of mutation tokens.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
SEPARATOR = ":"


def _lenient(text: str) -> str:
    number = "try_cast(substring(t, 2, length(t) - 2) AS int)"
    tokens = f"filter(transform(split({text}, '{SEPARATOR}'), t -> trim(t)), t -> length(t) >= 3 AND {number} IS NOT NULL)"
    return f"transform({tokens}, t -> named_struct('wt', upper(left(t, 1)), 'pos', {number}, 'mt', upper(right(t, 1))))"


def parse_mutations(text: str) -> Column:
    """Lenient parse: short tokens and tokens without a number are skipped."""
    return F.expr(f"coalesce({_lenient(text)}, cast(array() AS array<struct<wt:string,pos:int,mt:string>>))")


def _is_strict(text: str) -> str:
    return f"forall(split({text}, '{SEPARATOR}'), t -> t rlike '^[A-Z][0-9]+[A-Z]$')"


def parse_mutations_strict(text: str) -> Column:
    """Every token must read letter, number, letter; anything else is an error."""
    return F.expr(
        f"CASE WHEN {_is_strict(text)} THEN {_lenient(text)} "
        f"ELSE raise_error(concat('cannot parse mutation ', coalesce({text}, 'null'))) END"
    )


def mutation_problem(seq: str, text: str, start: int = 1) -> Column:
    """Why a mutation string cannot be applied, or null.

    The old residue is compared with the unmutated sequence. Positions before
    ``start`` are rejected.
    """
    check = (
        f"CASE WHEN m.pos < {start} OR m.pos - {start} >= length({seq}) THEN concat('position outside the sequence: ', m.wt, m.pos, m.mt) "
        f"WHEN substring({seq}, m.pos - {start} + 1, 1) <> m.wt THEN concat('old residue differs: ', m.wt, m.pos, m.mt) "
        f"WHEN instr('{RESIDUES}', m.mt) = 0 THEN concat('new residue is not standard: ', m.wt, m.pos, m.mt) END"
    )
    cased = _lenient(text).replace("upper(left(t, 1))", "left(t, 1)").replace("upper(right(t, 1))", "right(t, 1)")
    return F.expr(
        f"CASE WHEN NOT forall(split({text}, '{SEPARATOR}'), t -> length(t) >= 3 AND try_cast(substring(t, 2, length(t) - 2) AS int) IS NOT NULL) "
        f"THEN concat('cannot parse mutation ', {text}) "
        f"ELSE get(filter(transform({cased}, m -> {check}), p -> p IS NOT NULL), 0) END"
    )


def place_mutations(seq: str, text: str, start: int = 1) -> Column:
    """Mutated sequence of a mutation string that is known to be valid (part of C3)."""
    return F.expr(
        f"aggregate({_lenient(text)}, {seq}, (s, m) -> overlay(s PLACING m.mt FROM m.pos - {start} + 1 FOR 1))"
    )


def apply_mutations(seq: str, text: str, start: int = 1, on_error: str = "raise") -> Column:
    """Mutated sequence (C3); problems raise, or give null with ``on_error='null'``."""
    built = place_mutations(seq, text, start)
    problem = mutation_problem(seq, text, start)
    bad = F.raise_error(problem) if on_error == "raise" else F.lit(None).cast("string")
    return F.when(problem.isNull(), built).otherwise(bad)


def _checked(seq: str, text: str, offset: int) -> str:
    """Fold over the tokens with the sequence, the set positions and the first problem."""
    at = f"(m.pos - {offset} + 1)"
    now = f"upper(substring(a.s, {at}, 1))"
    step = (
        f"CASE WHEN a.err IS NOT NULL OR {at} < 1 OR {at} > length(a.s) THEN a "
        f"WHEN array_contains(a.done, {at}) THEN "
        f"CASE WHEN {now} = m.mt THEN a ELSE named_struct('s', a.s, 'done', a.done, 'err', concat('conflicting mutations at position ', m.pos)) END "
        f"WHEN {now} = m.wt THEN named_struct('s', overlay(a.s PLACING m.mt FROM {at} FOR 1), 'done', array_append(a.done, {at}), 'err', a.err) "
        f"WHEN {now} = m.mt THEN named_struct('s', a.s, 'done', array_append(a.done, {at}), 'err', a.err) "
        f"ELSE named_struct('s', a.s, 'done', a.done, 'err', concat('old residue differs at position ', m.pos)) END"
    )
    seed = f"named_struct('s', {seq}, 'done', cast(array() AS array<int>), 'err', cast(NULL AS string))"
    return f"aggregate({_lenient(text)}, {seed}, (a, m) -> {step})"


def apply_mutations_checked(seq: str, text: str, offset: int = 1, on_error: str = "raise") -> Column:
    """Tolerant application (C4): ``WT`` or nothing is the identity, sites outside
    are skipped, a repeated site must ask for the same residue."""
    bad = f"raise_error({_checked(seq, text, offset)}.err)" if on_error == "raise" else "cast(NULL AS string)"
    return F.expr(
        f"CASE WHEN {text} IS NULL OR upper(trim({text})) IN ('', 'WT') THEN {seq} "
        f"WHEN {_checked(seq, text, offset)}.err IS NOT NULL THEN {bad} ELSE {_checked(seq, text, offset)}.s END"
    )


def shift_mutations(text: str, start: int, undo: bool = False) -> Column:
    """Move positions to (``-start+1``) or back from (``+start-1``) alignment coordinates."""
    delta = start - 1 if undo else 1 - start
    moved = f"concat(left(t, 1), cast(substring(t, 2, length(t) - 2) AS int) + {delta}, right(t, 1))"
    return F.expr(f"array_join(transform(split({text}, '{SEPARATOR}'), t -> {moved}), '{SEPARATOR}')")

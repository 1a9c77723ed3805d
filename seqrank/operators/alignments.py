"""Alignment operators (K1-K4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import attach_row, hash_key
from ..session import checkpoint_dir

# Numbered positions of the antibody axis and the three positions
# whose insertions count down before the position itself.
LAST_POSITION = 128
REVERSED_INSERTIONS = (33, 61, 112)
GAP = "-"


def equal_share(a: str, b: str) -> Column:
    """Share of equal columns over the shorter row, gaps included."""
    n = f"least(length({a}), length({b}))"
    letters = [f"slice(split({x}, ''), 1, {n})" for x in (a, b)]
    same = f"aggregate(zip_with({letters[0]}, {letters[1]}, (x, y) -> if(x = y, 1D, 0D)), 0D, (s, v) -> s + v)"
    return F.expr(f"{same} / nullif({n}, 0)")


def msa_identity(msa: DataFrame, row: str = "row_idx", seq: str = "seq", given: str | None = None) -> DataFrame:
    """Identity of every row to the query row, three decimals (K1).

    The query is the row with the smallest ``row``; a number in ``given`` takes
    precedence over the computed identity.
    """
    query = msa.agg(F.min_by(seq, row).alias("_query"), F.min(row).alias("_query_row"))
    rows = attach_row(msa, query)
    value = F.round(equal_share("_query", seq), 3)
    if given:
        value = F.coalesce(F.col(given).try_cast("double"), value)
    return rows.withColumn("identity", value).withColumn("is_query", F.col(row) == F.col("_query_row")).drop("_query", "_query_row")


def by_identity(msa: DataFrame, row: str = "row_idx") -> DataFrame:
    """Query first, then the most similar rows (K1)."""
    return msa.orderBy(F.desc("is_query"), F.desc("identity"), row)


def letter_words(seq: str) -> Column:
    """Eight letters in each number, so that rows are compared by exclusive or; null for text beyond ASCII and empty text."""
    word = f"cast(conv(hex(substring({seq}, i * 8 + 1, 8)), 16, 10) AS bigint)"
    return F.expr(f"CASE WHEN length({seq}) > 0 AND octet_length({seq}) = length({seq}) THEN transform(sequence(0, (length({seq}) + 7) div 8 - 1), i -> {word}) END")


def _unequal_share(words: str, seq: str, other_words: str, other: str) -> str:
    """SQL of 1 - :func:`equal_share`: packed for ASCII rows of one length, by letters otherwise; 0 where undefined."""
    # Each byte is folded into its lowest bit; the mask keeps one bit per letter.
    folded = f"transform(transform(zip_with({words}, {other_words}, (x, y) -> x ^ y), d -> d | shiftright(d, 4)), d -> d | shiftright(d, 2))"
    packed = f"aggregate({folded}, 0L, (s, d) -> s + bit_count((d | shiftright(d, 1)) & {0x0101010101010101}L)) / length({seq})"
    n = f"least(length({seq}), length({other}))"
    same = f"aggregate(zip_with(slice(split({seq}, ''), 1, {n}), slice(split({other}, ''), 1, {n}), (x, y) -> if(x = y, 1D, 0D)), 0D, (s, v) -> s + v)"
    return f"CASE WHEN {words} IS NOT NULL AND {other_words} IS NOT NULL AND length({seq}) = length({other}) THEN {packed} ELSE coalesce(1D - {same} / nullif({n}, 0), 0D) END"


def greedy_diverse(
    msa: DataFrame, n: int | None = None, budget: int | None = None, mode: str = "max", seed: int = 0,
    row: str = "row_idx", seq: str = "seq", settle_every: int = 16,
) -> DataFrame:
    """Rows farthest from (or nearest to) the chosen set, one per round (K2).

    Starts at the first row in hash order. ``n`` counts rows; ``budget`` counts
    residues of the rows picked after the first one; ``row`` identifies rows. Adds ``pick`` and
    ``shuffle_key``, the order of the output.

    A row carries the sum of its distances to the picks it has met. The
    distance to each pick it has not met lies between 0 and 1, so a row whose bound cannot
    reach the last round's second best is not compared at all. Picks travel as one row, thus
    every round has the same plan; the sums of the compared rows are settled in a
    checkpoint every ``settle_every`` rounds. All picks are sent to every task, which
    the caller's ``n`` or ``budget`` bounds.
    """
    if (n is None) == (budget is None):
        raise ValueError("give either a row count or a residue budget")
    spark = msa.sparkSession
    checkpoint_dir(spark)
    rows = msa.withColumn("shuffle_key", hash_key(seed, F.col(row)))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.replace(seq, F.lit(GAP), F.lit("")))).alias("residues")).first()
    if (n is not None and size["rows"] <= n) or (budget is not None and (size["residues"] or 0) <= budget):
        return rows.withColumn("pick", F.lit(None).cast("int"))
    # Numbers of words, not of letters, are what a round reads.
    state = rows.select(F.col(row).alias("_row"), F.col(seq).alias("_seq"), "shuffle_key").withColumns({
        "_words": letter_words("_seq"), "_sum": F.lit(0.0), "_met": F.lit(0)}).checkpoint()
    start = state.orderBy("shuffle_key").first()
    picks, used, edge = [start], 0, None
    entry = state.select(F.struct("_row", "_seq", "_words").alias("p")).schema["p"].dataType
    head = T.StructType([T.StructField("_picks", T.ArrayType(entry)), T.StructField("_edge", T.DoubleType())])
    share = _unequal_share("_words", "_seq", "p._words", "p._seq")
    met = f"_sum + aggregate(slice(_picks, _met + 1, size(_picks) - _met), 0D, (s, p) -> s + {share})"
    reach = "_sum + size(_picks) - _met >= _edge - 1e-6" if mode == "max" else "_sum <= _edge + 1 + 1e-6"
    while not (n is not None and len(picks) >= n or budget is not None and used >= budget or len(picks) >= size["rows"]):
        now = spark.createDataFrame([([(p["_row"], p["_seq"], p["_words"]) for p in picks], edge)], head)
        open_rows = attach_row(state, now).filter("NOT exists(_picks, p -> p._row = _row)")
        due = F.expr(f"_edge IS NULL OR {reach}")
        if len(picks) % settle_every == 0:
            state = open_rows.select(
                "_row", "_seq", "shuffle_key", "_words", F.when(due, F.expr(met)).otherwise(F.col("_sum")).alias("_sum"),
                F.when(due, F.expr("size(_picks)")).otherwise(F.col("_met")).alias("_met")).checkpoint()
            open_rows = attach_row(state, now)
        rank = F.col("_now") if mode == "max" else -F.col("_now")
        # The best sum wins, the earlier shuffled row on ties; the second best bounds the next round.
        best = open_rows.filter(due).withColumn("_now", F.expr(met)).orderBy(F.round(rank, 9).desc(), "shuffle_key").select("_row", "_seq", "_words", "_now").take(2)
        if not best:
            break
        picks.append(best[0])
        edge = best[1]["_now"] if len(best) > 1 else None
        letters = best[0]["_seq"] or ""
        used += len(letters) - letters.count(GAP)
    chosen = spark.createDataFrame([(p["_row"], i) for i, p in enumerate(picks)], T.StructType([T.StructField("_row", entry["_row"].dataType), T.StructField("pick", T.IntegerType())]))
    return rows.join(chosen, rows[row] == chosen["_row"]).drop("_row")


def axis_ordinal(position: str, insertion: str) -> Column:
    """Place of a numbered position on the axis: start mark, 1..128 with letters, end mark."""
    letter = f"(ascii({insertion}) - ascii('A') + 1)"
    reverse = ", ".join(str(p) for p in REVERSED_INSERTIONS)
    inner = f"CASE WHEN trim({insertion}) = '' THEN if(cast({position} AS int) IN ({reverse}), 27, 0) WHEN cast({position} AS int) IN ({reverse}) THEN 27 - {letter} ELSE {letter} END"
    return F.expr(f"CASE WHEN {position} = '<' THEN 0 WHEN {position} = '>' THEN {(LAST_POSITION + 1) * 100} ELSE try_cast({position} AS int) * 100 + {inner} END")


def numbering_axis(used: DataFrame, chain: str = "chain", position: str = "position", insertion: str = "insertion", residue: str = "residue") -> DataFrame:
    """Used positions of each chain in canonical order (K3); gap-only positions are left out.

    A chain uses at most 128 x 27 + 2 positions, so the index window is small.
    """
    from pyspark.sql import Window

    spots = used.filter(F.col(residue) != GAP).select(chain, F.col(position).cast("string").alias("position"), F.col(insertion).alias("insertion")).distinct()
    placed = spots.withColumn("ordinal", axis_ordinal("position", "insertion"))
    return placed.withColumn("axis_idx", F.row_number().over(Window.partitionBy(chain).orderBy("ordinal")) - 1)


def align_to_axis(residues: DataFrame, axis: DataFrame, key: str, chain: str = "chain", vec: str | None = None, chains: Sequence[str] = ("H", "L")) -> DataFrame:
    """Each sequence spread on the axis, gaps filled (K4).

    Chains are joined by ``|``. With ``vec`` the residue vectors are spread
    too, gaps as zeros.
    """
    width = 0
    if vec:
        first = residues.select(F.size(vec).alias("w")).first()
        width = first["w"] if first else 0
    item = [F.col("residue")] + ([F.col(vec)] if vec else [])
    named = residues.withColumn("ordinal", axis_ordinal("position", "insertion"))
    held = named.groupBy(key, chain).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", F.struct(*item).alias("v")))).alias("_m"))
    out = held.select(key).distinct()
    spots = axis.groupBy().pivot(chain, list(chains)).agg(F.expr("transform(array_sort(collect_list(struct(axis_idx, ordinal))), s -> s.ordinal)"))
    out = attach_row(out, spots)
    texts, vectors = [], []
    for c in chains:
        one = held.filter(F.col(chain) == c).select(key, F.col("_m").alias(f"_m_{c}"))
        out = out.join(one, key, "left")
        get = f"coalesce(_m_{c}[o].residue, '{GAP}')"
        texts.append(F.expr(f"array_join(transform(coalesce(`{c}`, array()), o -> {get}), '')"))
        if vec:
            zeros = f"array_repeat(0D, {width})"
            vectors.append(F.expr(f"transform(coalesce(`{c}`, array()), o -> coalesce(cast(_m_{c}[o].{vec} AS array<double>), {zeros}))"))
    columns = [F.concat_ws("|", *texts).alias("aligned")]
    if vec:
        columns.append(F.concat(*vectors).alias("aligned_vectors"))
    return out.select(key, *columns)



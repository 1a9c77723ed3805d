"""Scores from model output tables (D1-D20). Model outputs are data, one row per residue."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mutation_text import _lenient, parse_mutations, parse_mutations_strict
from ..session import checkpoint_dir, written

# Fixed values of the long-sequence windows: sigmoid midpoint and slope of the edge weights.
EDGE_MIDPOINT, EDGE_SLOPE = 128, 16
SPECIAL_TOKENS = 2


def log_softmax(df: DataFrame, keys: Sequence[str], logit: str = "logit", temperature: float = 1.0, out: str = "logprob") -> DataFrame:
    """Log-probability of every residue at its position (D6); a window holds one vocabulary."""
    return log_softmaxes(df, keys, {out: temperature}, logit)


def log_softmaxes(df: DataFrame, keys: Sequence[str], temperatures: Mapping[str, float], logit: str = "logit") -> DataFrame:
    """Log-probabilities at several temperatures, one column each, from one pass for the maxima and one for the sums."""
    w = Window.partitionBy(*keys)
    x = {name: F.col(logit) / F.lit(float(t)) for name, t in temperatures.items()}
    tops = {name: F.col(f"_top_{name}") for name in x}
    rows = df.select("*", *[F.max(x[name]).over(w).alias(f"_top_{name}") for name in x])
    rows = rows.select("*", *[F.sum(F.exp(x[name] - tops[name])).over(w).alias(f"_sum_{name}") for name in x])
    return rows.withColumns({name: x[name] - tops[name] - F.log(F.col(f"_sum_{name}")) for name in x}).drop(
        *[f"_{kind}_{name}" for name in x for kind in ("top", "sum")])


def position_table(lp: DataFrame, keys: Sequence[str], aa: str = "aa", value: str = "logprob") -> DataFrame:
    """One row per position with the residue scores as a map (at most one vocabulary)."""
    entries = F.collect_list(F.struct(F.col(aa).alias("k"), F.col(value).alias("v")))
    return lp.groupBy(*keys).agg(F.map_from_entries(entries).alias("_scores"))


def at_asked(lp: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``lp`` at the positions ``keys, _pos`` of ``asked``; outputs where no row has a site change no score.

    As a condition on the key of a position it is asked before a softmax by position, where a join would come after it.
    """
    place = ", ".join(f"`{k}`" for k in keys)
    places = asked.select(*keys, "_pos").distinct().hint("shuffle_hash")
    return lp.sparkSession.sql(f"SELECT * FROM {{lp}} WHERE ({place}, pos) IN (SELECT * FROM {{places}})", lp=lp, places=places)


def score_delta_logprob(
    muts: DataFrame, lp: DataFrame, row_id: str, seq_key: str, mutant: str = "mutant", seq: str | None = None,
    offset: int = 1, out: str = "score", wt_value: str = "logprob", mt_value: str = "logprob", on_mismatch: str = "raise",
    chains: DataFrame | None = None,
) -> DataFrame:
    """Sum over sites of log P(new) - log P(old).

    ``lp`` holds ``(seq_key, pos, aa, <values>)`` with 1-based ``pos``. Sites
    outside the table and residues outside the vocabulary add nothing; rows
    without a site score 0, and rows whose sequence has no output at all are
    null. With ``seq`` the old residue is checked against
    the sequence: a mismatch raises, or makes the score null. With ``chains``,
    the output of ``concat_chains``, ``lp`` is chain-wise (a column ``chain``),
    sites are places of the concatenated sequence, and a complex whose chains
    overlap there raises.
    """
    keys = [seq_key] + (["chain"] if chains is not None else [])
    columns = [row_id, seq_key, F.col(mutant).alias("_mut")] + ([F.col(seq).alias("_seq")] if seq else [])
    text = muts.select(*columns).select(
        "*", F.expr("CASE WHEN trim(_mut) = 'WT' THEN '' ELSE coalesce(_mut, '') END").alias("_text"))
    sites = text.select(row_id, seq_key, *(["_seq"] if seq else []), F.posexplode_outer(parse_mutations("_text")).alias("_i", "_m"))
    sites = sites.withColumn("_pos", F.coalesce(F.col("_m.pos") - F.lit(offset - 1), F.lit(0)))
    if seq:
        # Checked before the join, so the sequences aren't shuffled.
        wrong = F.expr("_pos >= 1 AND _pos <= length(_seq) AND upper(substring(_seq, _pos, 1)) <> _m.wt")
        sites = sites.withColumn("_bad", F.when(wrong, F.concat(F.col("_m.wt"), F.col("_m.pos"), F.col("_m.mt")))).drop("_seq")
    # Parsed once: positions are asked of the outputs first, then rows meet their scores.
    sites = written(sites.drop("_i"))
    asked = sites.filter("_m IS NOT NULL").select(seq_key, "_pos", F.explode(F.array("_m.wt", "_m.mt")).alias("_aa")).distinct()
    known = lp.select(F.col(seq_key).alias("_known")).distinct()
    delta = F.expr(f"try_element_at(_scores, _m.mt).`{mt_value}` - try_element_at(_scores, _m.wt).`{wt_value}`")
    if chains is not None:
        sites, asked = stitch_chains(sites, chains, seq_key), stitch_chains(asked, chains, seq_key)
        # Where the outputs of one chain reach into the place of another, a site has no single output.
        reach = lp.groupBy(*keys).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).join(placed_chains(chains, seq_key), keys)
        reach = reach.groupBy(F.col(seq_key).alias("_known")).agg(F.array_sort(F.collect_list(F.struct(F.expr("lo + _off").alias("lo"), F.expr("hi + _off").alias("hi")))).alias("r"))
        known = reach.select("_known", F.expr("coalesce(exists(sequence(1, size(r)), i -> get(r, i).lo <= get(r, i - 1).hi), false)").alias("_overlap"))
    # Only letters that a site names become a map; maps put one vocabulary in one row, so the
    # join shuffles positions, not residues, and each site joins once.
    letters = asked.groupBy(*keys, F.col("_pos").alias("pos")).agg(F.collect_set("_aa").alias("_letters")).hint("merge")
    met = at_asked(lp, asked, keys).join(letters, [*keys, "pos"]).filter("array_contains(_letters, aa)")
    values = sorted({wt_value, mt_value})
    table = met.groupBy(*keys, F.col("pos").alias("_pos")).agg(
        F.map_from_entries(F.collect_list(F.struct("aa", F.struct(*values)))).alias("_scores"))
    joined = sites.join(table, [*keys, "_pos"], "left")
    aggs = [F.coalesce(F.sum(delta), F.lit(0.0)).alias(out), F.max(F.when(F.col("_m").isNotNull(), F.col(seq_key))).alias("_key")]

    def checked(rows: DataFrame) -> DataFrame:
        lacks = F.col("_key").isNotNull() & F.col("_known").isNull()
        met = rows.join(known, F.col("_key") == F.col("_known"), "left")
        value = F.when(~lacks, F.col(out))
        if chains is not None:
            value = F.when(F.col("_overlap"), F.raise_error(F.lit("outputs of chains overlap")).cast("double")).otherwise(value)
        return met.withColumn(out, value).select(*[c for c in rows.columns if c != "_key"])

    if not seq:
        return checked(joined.groupBy(row_id).agg(*aggs))
    scored = checked(joined.groupBy(row_id).agg(*aggs, F.max("_bad").alias("_bad")))
    bad = F.raise_error(F.concat(F.lit("old residue differs: "), F.col("_bad"))) if on_mismatch == "raise" else F.lit(None)
    return scored.select(row_id, F.when(F.col("_bad").isNull(), F.col(out)).otherwise(bad.cast("double")).alias(out))


def score_temperature(
    muts: DataFrame, logits: DataFrame, row_id: str, seq_key: str, mutant: str = "mutant", start: int = 1,
    t_mt: float = 1.0, t_wt: float = 1.5, out: str = "score",
) -> DataFrame:
    """Two temperatures of the same logits, rounded to five decimals."""
    both = log_softmaxes(logits, [seq_key, "pos"], {"lp_mt": t_mt, "lp_wt": t_wt})
    scored = score_delta_logprob(muts, both, row_id, seq_key, mutant, offset=start, out=out, wt_value="lp_wt", mt_value="lp_mt")
    return scored.withColumn(out, F.round(out, 5))


def score_paired(
    muts: DataFrame, lp: DataFrame, row_id: str, seq_key: str, mut_heavy: str, mut_light: str, heavy: str, light: str,
    out: str = "score", on_mismatch: str = "null",
) -> DataFrame:
    """Heavy and light chain scored on one table.

    Light positions start after the heavy chain and one separator. Sites
    outside their own chain are skipped; a mismatching old residue makes the
    row null, and a missing chain scores 0.
    """
    def placed(text: str, seq: str, shift: str) -> str:
        inside = f"filter({_lenient(text)}, m -> m.pos >= 1 AND m.pos <= length({seq}))"
        return f"transform({inside}, m -> named_struct('wt', m.wt, 'pos', m.pos + {shift}, 'mt', m.mt, 'bad', upper(substring({seq}, m.pos, 1)) <> m.wt))"

    def text(c: str) -> str:
        return f"CASE WHEN {c} IS NULL OR trim({c}) = 'WT' THEN '' ELSE {c} END"

    both = f"concat({placed(text(mut_heavy), heavy, '0')}, {placed(text(mut_light), light, f'length({heavy}) + 1')})"
    usable = f"coalesce({heavy}, '') <> '' AND coalesce({light}, '') <> ''"
    sites = muts.select(row_id, seq_key, F.explode_outer(F.expr(f"CASE WHEN {usable} THEN {both} END")).alias("_m"))
    sites = written(sites.withColumn("_pos", F.coalesce(F.col("_m.pos"), F.lit(0))))
    lp = at_asked(lp, sites.filter("_m IS NOT NULL"), [seq_key])
    table = position_table(lp, [seq_key, "pos"]).withColumnRenamed("pos", "_pos")
    delta = F.expr("try_element_at(_scores, _m.mt) - try_element_at(_scores, _m.wt)")
    scored = sites.join(table, [seq_key, "_pos"], "left").groupBy(row_id).agg(
        F.coalesce(F.sum(delta), F.lit(0.0)).alias("_s"), F.coalesce(F.bool_or("_m.bad"), F.lit(False)).alias("_bad"))
    bad = F.raise_error(F.lit("old residue differs")).cast("double") if on_mismatch == "raise" else F.lit(None).cast("double")
    return scored.select(row_id, F.when(F.col("_bad"), bad).otherwise(F.col("_s")).alias(out))


def placed_chains(chains: DataFrame, poi: str = "POI") -> DataFrame:
    """``chain`` and its offset ``_off`` per kept chain, from the output of ``concat_chains``."""
    placed = chains.select(poi, F.explode(F.arrays_zip("chains", "offsets")).alias("_c"))
    return placed.select(poi, F.col("_c.chains").alias("chain"), F.col("_c.offsets").alias("_off"))


def stitch_chains(sites: DataFrame, chains: DataFrame, poi: str = "POI") -> DataFrame:
    """Sites of the concatenated sequence (``_pos``) at the chain-wise positions that are stitched there (input of D3).

    A site meets every kept chain of its POI and has outputs in the one that reaches there. Sites move
    and not the log-probabilities, which are many times as many.
    """
    return sites.join(placed_chains(chains, poi), poi, "left").withColumn("_pos", F.col("_pos") - F.col("_off")).drop("_off")


def score_per_chain(muts: DataFrame, lp: DataFrame, chains: DataFrame, row_id: str, poi: str = "POI", mutant: str = "mutant_global", out: str = "score") -> DataFrame:
    """Chain-wise log-probabilities stitched in offset order, then scored (D3)."""
    return score_delta_logprob(muts, lp, row_id, poi, mutant, out=out, chains=chains)


def embedding_shift(a: str, b: str) -> Column:
    """Minus the mean squared difference of two vectors."""
    return F.expr(f"-aggregate(zip_with({a}, {b}, (x, y) -> pow(cast(x AS double) - cast(y AS double), 2)), 0D, (s, v) -> s + v) / nullif(size({a}), 0)")


def score_embedding_shift(wt: DataFrame, mut: DataFrame, key: Sequence[str], vec: str = "vec", groups: Sequence[str] = ()) -> DataFrame:
    """Embedding distance of mutants to their wild type (D5), averaged over positions inside ``groups``."""
    other = wt.select(*key, F.col(vec).alias("_wt"))
    scored = mut.join(other, list(key)).withColumn("score", embedding_shift("_wt", vec)).drop("_wt", vec)
    return scored.groupBy(*groups).agg(F.avg("score").alias("score")) if groups else scored


def plan_windows_overlap(df: DataFrame, length: str, window: int) -> DataFrame:
    """Window pairs moving inward from both ends, then a centre patch if the overlap is thin.

    ``length`` counts tokens including the two special ones; ``win_start`` and
    ``win_end`` are inclusive. Sequences that fit get one ``whole`` window.
    """
    stride = max(1, window // 2 - 1)
    # Steps until the left window's end passes the right window's start:
    # W-1 + k*stride > T - W - k*stride.
    steps = f"cast(greatest(0, floor(({length} - {2 * window} + 1) / {2 * stride}D) + 1) AS int)"
    overlap = f"({2 * window} - {length} + 2 * {stride} * {steps})"
    center = f"greatest(0, floor({length} / 2) - {window // 2})"
    pair = (
        f"flatten(transform(sequence(0, {steps}), k -> array("
        f"named_struct('kind', 'left', 'win_start', cast(k * {stride} AS bigint), 'win_end', cast(k * {stride} + {window - 1} AS bigint)), "
        f"named_struct('kind', 'right', 'win_start', cast({length} - {window} - k * {stride} AS bigint), 'win_end', cast({length} - 1 - k * {stride} AS bigint)))))"
    )
    patch = (
        f"array(named_struct('kind', 'center', 'win_start', cast({center} AS bigint), "
        f"'win_end', cast(least({length} - 1, {center} + {window - 1}) AS bigint)))"
    )
    empty = "cast(array() AS array<struct<kind:string,win_start:bigint,win_end:bigint>>)"
    whole = f"array(named_struct('kind', 'whole', 'win_start', 0L, 'win_end', cast({length} - 1 AS bigint)))"
    plan = f"CASE WHEN {length} <= {window} THEN {whole} ELSE concat({pair}, if({overlap} < {stride}, {patch}, {empty})) END"
    return df.select("*", F.inline(F.expr(plan)))


def plan_windows_masked(df: DataFrame, length: str, window: int) -> DataFrame:
    """One row per residue with the window that masks it (D8); ``length`` counts special tokens."""
    rows = df.select("*", F.explode(F.expr(f"sequence(1, cast({length} AS int) - {SPECIAL_TOKENS})")).alias("token"))
    start = F.expr(f"CASE WHEN {length} <= {window} THEN 0 ELSE least(greatest(token - {window // 2}, 0), {length} - {window}) END")
    return rows.withColumn("win_start", start.cast("int")).withColumn("masked_at", F.col("token") - F.col("win_start"))


def window_weight(index: str, window: int, edge: int = 256) -> Column:
    """Weight of a token inside a long-sequence window (D9); the special ends weigh 1."""
    if window < 4:
        return F.expr(f"if({index} IS NULL, NULL, 1D)")
    anchor = window - 2
    left = f"1D / (1D + exp(-({index} - {EDGE_MIDPOINT}) / {EDGE_SLOPE}D))"
    right = f"1D / (1D + exp(({index} - {anchor} + {EDGE_MIDPOINT}) / {EDGE_SLOPE}D))"
    # Where both edges reach, the right one was written last.
    return F.expr(
        f"CASE WHEN {index} >= {max(0, anchor - edge)} AND {index} <= {anchor} THEN {right} "
        f"WHEN {index} >= 1 AND {index} <= {min(edge, anchor)} THEN {left} ELSE 1D END"
    )


def blend_windows(lp: DataFrame, keys: Sequence[str], window: int, edge: int = 256, weighted: bool = True) -> DataFrame:
    """Mean of overlapping window log-probabilities.

    ``lp`` has ``keys, win_start, offset, aa, logprob`` and the token count
    ``length``; tokens 0 and ``length - 1`` are special and dropped, positions
    come out 1-based.
    """
    token = (F.col("win_start") + F.col("offset")).alias("pos")
    weight = window_weight("offset", window, edge) if weighted else F.lit(1.0)
    rows = lp.select(*keys, "length", token, "aa", "logprob", weight.alias("_w"))
    rows = rows.filter((F.col("pos") >= 1) & (F.col("pos") < F.col("length") - 1))
    return rows.groupBy(*keys, "pos", "aa").agg((F.sum(F.col("logprob") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias("logprob"))


def chunk_sequences(df: DataFrame, seq: str, size: int) -> DataFrame:
    """Contiguous chunks of at most ``size`` residues."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    starts = f"sequence(0, cast(greatest(length({seq}) - 1, 0) / {size} AS int))"
    rows = df.select("*", F.explode(F.expr(starts)).alias("chunk"))
    return rows.withColumn("chunk_text", F.expr(f"substring({seq}, chunk * {size} + 1, {size})"))


def sequence_loglik(tokens: DataFrame, key: str, reduction: str | Sequence[str] = "sum", length: str | None = None) -> DataFrame:
    """Sequence score from token log-probabilities.

    ``tokens`` has ``key, chunk, direction, logprob`` and ``is_residue``;
    terminals are left out. ``sum``: chunk means over both directions, halved;
    ``per_residue``: that divided by the sequence length; ``mean``: mean over
    chunks and directions; ``total``: half the sum of residue log-probabilities;
    ``forward_total``: sum of residue log-probabilities. One reduction gives the
    column ``score``; a list of them gives one column each from the same aggregate.
    """
    lengths = [F.max(length).alias("_len")] if length else []
    chunks = tokens.filter("is_residue").groupBy(key, "chunk", "direction").agg(
        F.avg("logprob").alias("_mean"), F.sum("logprob").alias("_sum"), *lengths)
    scores = {
        "sum": F.sum("_mean") / 2.0,
        "per_residue": F.sum("_mean") / 2.0 / F.greatest(F.max("_len"), F.lit(1)) if length else None,
        "mean": F.avg("_mean"),
        "total": F.sum("_sum") / 2.0,
        "forward_total": F.sum("_sum"),
    }
    wanted = {"score": reduction} if isinstance(reduction, str) else {r: r for r in reduction}
    return chunks.groupBy(key).agg(*[scores[r].alias(name) for name, r in wanted.items()])


def delta_vs_wildtype(scores: DataFrame, wt_scores: DataFrame, poi: str, score: str = "score", out: str = "delta") -> DataFrame:
    """Mutant score minus the wild-type score of its POI (D13); null without one."""
    base = wt_scores.select(poi, F.col(score).alias("_wt"))
    return scores.join(base, poi, "left").withColumn(out, F.col(score) - F.col("_wt")).drop("_wt")


def pseudo_loglik(lp: DataFrame, seqs: DataFrame, key: str, seq: str, empty: float | None = None) -> DataFrame:
    """Mean log-probability of the observed residues."""
    # A row per sequence meets its outputs in their order; its letters are looked up and never become rows.
    observed = seqs.select(key, F.col(seq).alias("_seq")).hint("merge")
    seen = lp.join(observed, key).filter("pos >= 1 AND aa <> '' AND substring(_seq, pos, 1) = aa")
    means = seen.groupBy(key).agg(F.avg("logprob").alias("pll"))
    value = F.col("pll") if empty is None else F.coalesce("pll", F.lit(empty))
    return seqs.select(key).join(means, key, "left").select(key, value.alias("pll"))


def residue_probability(logits: DataFrame, keys: Sequence[str], length: str | None = None) -> DataFrame:
    """Softmax per position, trimmed to the sequence length."""
    out = log_softmax(logits, keys, out="_lp").withColumn("probability", F.exp("_lp")).drop("_lp")
    return out.filter(F.col("pos") <= F.col(length)) if length else out


def restore_masked(seqs: DataFrame, logits: DataFrame, key: str, seq: str, mask: str = "*") -> DataFrame:
    """Replace masked positions by their best residue."""
    spots = seqs.select(key, F.posexplode(F.expr(f"filter(split({seq}, ''), a -> a <> '')")).alias("_i", "_a"))
    # Few spots meet many residues: residues stream past the spots of their task and aren't sorted.
    masked = spots.filter(F.col("_a") == mask).select(key, (F.col("_i") + 1).alias("pos")).hint("shuffle_hash")
    best = logits.join(masked, [key, "pos"]).groupBy(key, "pos").agg(F.max_by("aa", F.struct("logit", F.negative(F.ascii("aa")))).alias("aa"))
    fixes = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "aa"))).alias("_fix"))
    rebuilt = f"aggregate(map_entries(coalesce(_fix, cast(map() AS map<int,string>))), {seq}, (s, e) -> overlay(s PLACING e.value FROM e.key FOR 1))"
    return seqs.join(fixes, key, "left").withColumn("restored", F.expr(rebuilt)).drop("_fix")


def sequence_hash(c: Column) -> Column:
    """SHA-256 of the trimmed upper-case text: the cache key of model outputs."""
    return F.sha2(F.upper(F.trim(c)), 256)


def save_cache(cache: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Write model outputs ``(seq_hash, out)`` as a table bucketed by their key and read it again.

    A later join by ``seq_hash`` reads the buckets where they are and shuffles
    only the other side.
    """
    cache.write.mode("overwrite").bucketBy(buckets, "seq_hash").sortBy("seq_hash").saveAsTable(table)
    return cache.sparkSession.table(table)


def infer_with_cache(
    df: DataFrame, seq: str, cache: DataFrame, model: Callable[[Iterator], Iterator], out: str = "score", out_type: str = "double"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run a model only on distinct unseen sequences.

    ``model`` is a ``mapInPandas`` function from ``(seq_hash, seq)`` batches to
    ``(seq_hash, out)`` batches; ``cache`` has ``(seq_hash, out)``, best as a
    table of :func:`save_cache`. The cache is read once: one join tells hits from
    misses and brings the cached outputs. Returns the rows with their output,
    the new cache rows to append, and hit counts.
    """
    keyed = df.withColumn("seq_hash", sequence_hash(F.col(seq)))
    wanted = keyed.select("seq_hash", F.upper(F.trim(F.col(seq))).alias("seq")).dropDuplicates(["seq_hash"])
    # Misses, hits and counts read the same join, and both returned frames the new
    # outputs, so each is written once and the model runs once.
    checkpoint_dir(df.sparkSession)
    looked = looked_up(wanted, cache, out).checkpoint()
    fresh = looked.filter("_hit IS NULL").select("seq_hash", "seq").mapInPandas(model, schema=f"seq_hash string, {out} {out_type}").checkpoint()
    known = looked.filter("_hit").select("seq_hash", F.col("_cached").alias(out)).unionByName(fresh)
    counts = looked.agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
    return keyed.join(known, "seq_hash", "left"), fresh, counts


def looked_up(wanted: DataFrame, cache: DataFrame, out: str) -> DataFrame:
    """``wanted`` with the cached output as ``_cached`` and ``_hit`` where there is one."""
    return wanted.join(cache.select("seq_hash", F.col(out).alias("_cached"), F.lit(True).alias("_hit")), "seq_hash", "left")


def with_toy_score(df: DataFrame, weights: Mapping[str, float], mutant: str = "mutant", out: str = "mock_score") -> DataFrame:
    """Demonstration scorer (D19): weight change minus 0.01 per position, six decimals."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = df.select("*", parse_mutations_strict(mutant).alias("_m"), table.alias("_w"))
    value = F.expr("round(aggregate(_m, 0D, (s, m) -> s + element_at(_w, m.mt) - element_at(_w, m.wt) - 0.01D * (m.pos - 1)), 6)")
    return rows.withColumn(out, value).drop("_m", "_w")


def toy_score(df: DataFrame, weights: Mapping[str, float], row_id: str, mutant: str = "mutant", out: str = "mock_score") -> DataFrame:
    """The scores of :func:`with_toy_score` by row id."""
    return with_toy_score(df, weights, mutant, out).select(row_id, out)


def token_weighted_perplexity(batches: DataFrame, loss: str = "loss", tokens: str = "tokens", groups: Sequence[str] = ()) -> DataFrame:
    """Token-weighted loss and its perplexity (D20); null without tokens."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.nullif(F.sum(tokens), F.lit(0))
    return batches.groupBy(*groups).agg(mean.alias("loss")).withColumn("perplexity", F.when(F.col("loss").isNotNull(), F.exp(F.least(F.lit(20.0), F.col("loss")))))

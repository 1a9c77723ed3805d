"""Mixing sources to target weights, in blocks of words.

The words of each source form one stream (documents in hash order) that is cut
into blocks of ``BLOCK`` words. Every output shard draws multinomial counts of
slots per source; slot j of a source belongs to epoch j // blocks and is mapped
by a pseudorandom permutation of that epoch to a block; slots and documents
meet by block number. Shards together give each source its target number of words
exactly: slots beyond the target are not filled, missing ones are dealt over the
shards, and the last slot of a source may take the start of a block only.

A null text has no words; a null source is a source of its own. Repeated rows are
documents of their own. Seeds and hashes are fixed, so a rerun agrees.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrank.functions.ordering import with_positions

from .common import written

BLOCK = 256
SHARD_SLOTS = 4096
# Rows of a cell of a stream, shards of a cell of draws, slots of a task, bytes of text of a batch.
CELL_ROWS, CELL_SHARDS, TASK_SLOTS, BATCH_BYTES = 500_000, 4096, 250_000, 4 << 20
# Sources with at least 1 / HEADS of the slots are drawn by themselves, the others in HEADS groups first.
HEADS = 4096
CYCLE = (5, 2, 1)
MOST = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Image of ``i`` under the pseudorandom permutation of 0..n-1 that ``key`` names.

    A Feistel network over the next even power of two; values beyond n walk on
    until they fall inside.
    """
    i, n, key = (np.asarray(a, dtype=np.uint64) for a in (i, n, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        left, right, m = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo]
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(r)) & m)
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key() -> Column:
    """Tells rows of one id with other texts or sources apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, _k, source, size, _s``: words of each row; ``_s`` names the source, also null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("_k"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"))


def _before(column: str, groups: list[str], order: list[str]) -> Column:
    """Sum of the column over the earlier rows of the group."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def plan(rows: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """One row per source: ``source, _s, rank, source_size, target, wanted``.

    All targets are a common level times the source's weight, or ``most`` times its
    size where that is less. The level rises until the targets share the sum of all
    sizes: each turn is one aggregate over the sources, of which three numbers
    reach the driver. Once all sources below the level are found it stays.
    """
    sums = rows.groupBy("source", "_s").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = written(with_positions(sums, [], {"rank": ["_null", "_s"]}).drop("_null"), "sources").withColumn(
        "_weight", F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.col("rank") % len(cycle) + 1).cast("int")))
    level, known, cap = 0.0, -1, F.col("source_size") * most
    while True:
        full = F.lit(level) * F.col("_weight") > cap
        got = ranked.where("source_size > 0").agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if not got["weight"] or got["n"] == known:
            break
        level, known = (got["all"] - got["held"]) / got["weight"], got["n"]
    target = F.least(F.lit(level) * F.col("_weight"), cap.cast("double"))
    return ranked.withColumn("target", target).withColumn("wanted", F.least(F.rint("target").cast("long"), cap)).drop("_weight")


def place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the source's plan, ``r`` (number among repeated rows) and ``at``: words of the stream before the row.

    Running totals are taken in hash cells of each source, whose number grows with
    the rows, and then over the cells. The plan reaches the rows with the
    totals of their cell, so a hot source is spread over many tasks.
    """
    cells = 64 + rows.count() // CELL_ROWS
    celled = rows.withColumn("_h", F.xxhash64("doc_id", "_k", F.lit(17))).withColumn("_c", F.pmod("_h", F.lit(cells)).cast("int"))
    sums = celled.groupBy("_s", "_c").agg(F.sum("size").alias("_n")).withColumn("_first", _before("_n", ["_s"], ["_c"])).drop("_n")
    heads = sums.join(sources.drop("source"), "_s")
    same = F.row_number().over(Window.partitionBy("_s", "_c", "_h", "doc_id", "_k").orderBy("size"))
    inside = celled.withColumn("_inside", _before("size", ["_s", "_c"], ["_h", "doc_id", "_k"])).withColumn("r", same)
    return inside.join(heads, ["_s", "_c"]).withColumn("at", F.col("_first") + F.col("_inside")).drop("_s", "_h", "_c", "_first", "_inside")


def _draws(sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """``shard, rank, n`` (n > 0): multinomial slots per source, and the number of shards.

    Large sources (at most ``HEADS``) and ``HEADS`` groups of small ones are drawn
    first, then the slots of a group among its sources, which is the same law.
    """
    spark = sources.sparkSession
    total = int(sources.agg(F.sum("quota")).first()[0] or 0)
    shards = -(-total // shard_slots)
    large = F.col("quota") * HEADS >= total
    groups = sources.where("quota > 0").withColumn("g", F.when(large, F.col("rank")).otherwise(-1 - F.col("rank") % HEADS))
    heads = groups.groupBy("g").agg(F.sum("quota").alias("quota")).orderBy("g").toPandas()
    names, share = heads["g"].to_numpy(dtype=np.int64), heads["quota"].to_numpy(dtype=np.float64) / max(total, 1)

    def draw(batches):
        for batch in batches:
            for shard in batch["id"]:
                left = min(shard_slots, total - int(shard) * shard_slots)
                n = np.random.default_rng([seed, int(shard)]).multinomial(left, share)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"shard": int(shard), "rank": names[at], "n": n[at]})

    first = spark.range(shards).mapInPandas(draw, "shard long, rank long, n long")
    if not (names < 0).any():
        return first, shards
    first = written(first, "draws-of-groups")
    members = groups.where("g < 0").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("of"))

    def share_out(batches):
        for batch in batches:
            out = []
            for shard, g, n, of in batch.itertuples(index=False, name=None):
                rank, quota = np.array([m["rank"] for m in of]), np.array([m["quota"] for m in of], dtype=np.float64)
                got = np.random.default_rng([seed, int(shard), -int(g)]).multinomial(int(n), quota / quota.sum())
                at = np.flatnonzero(got)
                out.append(pd.DataFrame({"shard": int(shard), "rank": rank[at], "n": got[at]}))
            if out:
                yield pd.concat(out)

    met = first.where("rank < 0").withColumnRenamed("rank", "g").join(members, "g").select("shard", "g", "n", "of")
    return first.where("rank >= 0").unionByName(met.mapInPandas(share_out, "shard long, rank long, n long")), shards


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """``rank, block, shard, epoch, take``: which block fills each slot of the mix.

    Slots are numbered per source over cells of shards and then over the cells;
    they are spread over tasks by their number before they become rows.
    """
    shape = sources.where("source_size > 0 and wanted > 0").select("rank", F.col("source_size").alias("size"), "wanted").withColumn("_per", F.expr(f"(size + {block - 1}) div {block}"))
    shape = shape.withColumn("quota", F.expr(f"(wanted div size) * _per + (wanted % size + {block - 1}) div {block}")).drop("_per")
    drawn, shards = _draws(shape, shard_slots, seed)
    if not shards:
        return sources.sparkSession.createDataFrame([], "rank long, block long, shard long, epoch long, take long")
    drawn = written(drawn, "draws")
    celled = drawn.withColumn("_c", F.expr(f"shard div {CELL_SHARDS}"))
    sums = celled.groupBy("rank", "_c").agg(F.sum("n").alias("_n")).withColumn("_first", _before("_n", ["rank"], ["_c"]))
    heads = sums.drop("_n").join(shape, "rank")
    tasks = 1 + shards * shard_slots // TASK_SLOTS
    dealt = celled.withColumn("_inside", _before("n", ["rank", "_c"], ["shard"])).join(heads, ["rank", "_c"]).withColumn("first", F.col("_first") + F.col("_inside"))
    filled = dealt.withColumn("stop", F.least(F.col("first") + F.col("n"), F.col("quota"))).where("first < stop").select("rank", "shard", "size", "wanted", "first", "stop")
    filled = filled.repartition(tasks, "shard", "rank").select("rank", "shard", "size", "wanted", F.explode(F.expr("sequence(first, stop - 1)")).alias("j"))
    got = drawn.groupBy("rank").agg(F.sum("n").alias("_n"))
    short = shape.join(got, "rank", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where("_n < quota").select(
        "rank", "size", "wanted", F.explode(F.expr("sequence(_n, quota - 1)")).alias("j"))
    settled = short.select("rank", F.pmod(F.xxhash64("rank", "j"), F.lit(shards)).alias("shard"), "size", "wanted", "j")

    def locate(batches):
        for b in batches:
            k, j, size, wanted = (b[c].to_numpy(dtype=np.int64) for c in ("rank", "j", "size", "wanted"))
            per_epoch, whole = -(-size // block), size // block
            epoch, i = j // per_epoch, j % per_epoch
            key = _mixed(k.astype(np.uint64) * np.uint64(1_000_003) + epoch.astype(np.uint64) + np.uint64(seed) * np.uint64(0x51ED27))
            inner = i < whole
            at = i.copy()
            if inner.any():
                at[inner] = permuted(i[inner], whole[inner], key[inner])
            length = np.where(inner, block, size % block)
            take = np.minimum(length, wanted - (epoch * size + i * block))
            yield pd.DataFrame({"rank": k, "block": at, "shard": b["shard"], "epoch": epoch, "take": take})

    return filled.unionByName(settled).mapInPandas(locate, "rank long, block long, shard long, epoch long, take long")


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The placed documents and the pieces of the mix.

    Pieces: ``doc_id, _k, rank, r, shard, epoch, start, stop`` - words of the
    document (from ``start``, before ``stop``) in one slot of a shard.
    """
    rows = written(sized(docs), "sizes")
    sources = plan(rows)
    placed = written(place(rows, sources), "placed")
    spread = placed.where("size > 0").select(
        "doc_id", "_k", "rank", "r", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    met = spread.join(slots(sources, block), ["rank", "block"])
    low = F.greatest(F.col("at"), F.col("block") * block) - F.col("at")
    high = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("take")) - F.col("at")
    pieces = met.select("doc_id", "_k", "rank", "r", "shard", "epoch", low.alias("start"), high.alias("stop")).where("start < stop")
    return placed, pieces


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: ``size, source_size, target, taken``."""
    placed, pieces = mix(docs)
    keys = ["doc_id", "_k", "rank", "r"]
    got = pieces.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    p, g = placed.alias("p"), got.alias("g")
    same = F.col("p.doc_id").eqNullSafe(F.col("g.doc_id"))
    for c in keys[1:]:
        same = same & (F.col(f"p.{c}") == F.col(f"g.{c}"))
    return p.join(g, same, "left").select("p.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The texts of the mix with the columns of ``docs``.

    One row per document, epoch and run of adjacent taken words; a document that
    an epoch takes as a whole keeps its text as it is. ``n_chars`` is renewed. Of
    rows that repeat id, text and source the other columns are those of the smallest one.
    """
    _, pieces = mix(docs)
    names, schema = docs.columns, docs.schema
    span = F.struct("epoch", "start", "stop")
    wanted = pieces.groupBy("doc_id", "_k", "r").agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    keyed = docs.withColumn("_k", _key()).withColumn("_id", F.col("doc_id").cast("long"))
    others = F.to_json(F.struct(*[F.col(c) for c in names if c != "text"]))
    whole = keyed.groupBy("_id", "_k").agg(F.min_by(F.struct(*names), others).alias("_row"))
    joined = whole.join(wanted, whole["_id"].eqNullSafe(wanted["doc_id"]) & (whole["_k"] == wanted["_k"])).select("_row.*", "_spans")
    at_text = names.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        word = re.compile("[^ \t-\r]+")
        for batch in batches:
            out: list[list] = []
            held = 0
            for *values, spans in batch.itertuples(index=False, name=None):
                text = values[at_text] or ""
                edges = [m.span() for m in word.finditer(text)]
                runs: list[list] = []
                for s in spans:
                    if runs and runs[-1][0] == s["epoch"] and runs[-1][2] == s["start"]:
                        runs[-1][2] = s["stop"]
                    else:
                        runs.append([s["epoch"], s["start"], s["stop"]])
                for _, a, z in runs:
                    made = list(values)
                    made[at_text] = text if (a, z) == (0, len(edges)) else text[edges[a][0]:edges[z - 1][1]]
                    if at_chars is not None:
                        made[at_chars] = len(made[at_text])
                    out.append(made)
                    held += len(made[at_text])
                    if held > BATCH_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(cut, schema)

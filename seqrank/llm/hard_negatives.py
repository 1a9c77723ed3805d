"""Hard negatives of anchors, found by filtering on summaries of vector segments.

Each component x becomes floor(256 x); the score of two vectors is their integer
inner product. A vector is cut into segments, and the mean m and the deviation s of
each are stored beside it. For segments of length L

    L (m_a m_b - s_a s_b) <= their part of the score <= L (m_a m_b + s_a s_b),

so the sums over segments bound the score. Pairs whose bounds miss the wanted scores
are dropped at the coarse level, the rest at the level of finer segments, and only
what is left is scored exactly.

Two passes share this filter. The first finds the positives of each anchor (the best
rows of its label), the second the negatives of each positive: rows of other labels
with a score between two shares of the positive's. In both an anchor's wanted scores
narrow as better rows are found.

Anchors come in blocks, rows in groups; a cell is one block with one group, and the
rows of a cell are read as a stream against its block, so a task holds one block and
one batch of rows. The rows of the first pass are split by label, a hot label into
several cells. A cell emits the best few per anchor, never all pairs.

Rows with a null id or label, a null or empty vector, or a null or non-finite
component take no part, nor do vectors of d components with one of size c where
d c^2 >= 2^63 or c >= 2^31 (scores would be no longs). Vectors of different lengths
are not compared. Rows that repeat an id count once: the smallest vector in array
order, then the smallest label. Ties go to the smaller id. Fewer positives or
negatives give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
FINE, COARSE = 16, 4
# Anchors of a block and rows of a group, at most.
BLOCK = 1 << 14
GROUP = 1 << 20
# Rows of a group at least, where more cells only serve the cores.
LEAST = 1 << 12
# Pairs that a task looks at together.
_ANCHORS, _ROWS = 256, 4096
# Survivors are gathered pair by pair below this share, else all pairs of a tile go on together.
_GATHER = 1 / 16
_SLACK = 1e-9


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: the rows that take part, with their integer components."""
    v = F.col("embedding").cast("array<double>")
    size = F.array_max(F.transform(v, lambda c: F.abs(c))) * SCALE + 1
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"), size.alias("c"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and size(v) > 0").where(finite)
    rows = rows.where((F.col("c") < 2.0**31) & (F.size("v") * F.col("c") * F.col("c") < 2.0**63))
    one = rows.groupBy("vec_id").agg(F.min(F.struct(F.transform("v", lambda c: F.floor(c * SCALE).cast("int")).alias("v"), "label")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def _edges(n: int, parts: int) -> np.ndarray:
    """Bounds of ``parts`` segments of ``n`` components (or as many as there are)."""
    return np.linspace(0, n, min(n, parts) + 1).round().astype(int)


def summarise(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment, both times the root of its length."""
    edges = _edges(x.shape[1], parts)
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    apart = x - np.repeat(mean, length, axis=1)
    return mean * np.sqrt(length), np.sqrt(np.add.reduceat(apart * apart, edges[:-1], axis=1))


def coarser(mean: np.ndarray, dev: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of the coarse segments from those of the fine ones they consist of."""
    length = np.diff(_edges(d, FINE))
    cut = _edges(len(length), COARSE)[:-1]
    whole = np.add.reduceat(length, cut)
    total, square = np.add.reduceat(mean * np.sqrt(length), cut, axis=1), np.add.reduceat(mean * mean + dev * dev, cut, axis=1)
    big = total / np.sqrt(whole)
    return big, np.sqrt(np.maximum(square - big * big, 0.0) + _SLACK * square)


class Side:
    """Ids, labels, components and summaries of some vectors of one length."""

    def __init__(self, ids, labels, x, mean, dev):
        self.ids, self.labels, self.x = ids, labels, x
        self.levels = [coarser(mean, dev, x.shape[1]), (mean, dev)]

    def cut(self, rows) -> "Side":
        out = object.__new__(Side)
        out.ids, out.labels, out.x = self.ids[rows], self.labels[rows], self.x[rows]
        out.levels = [(m[rows], s[rows]) for m, s in self.levels]
        return out


def wanted_pairs(a: Side, b: Side, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (place in ``a``, place in ``b``, score) that are ``allowed`` and have a score from ``low`` to ``high`` of their anchor."""
    norms = np.sqrt((a.levels[1][0] ** 2).sum(1) + (a.levels[1][1] ** 2).sum(1))
    slack = 1 + _SLACK * norms * np.sqrt(((b.levels[1][0] ** 2).sum(1) + (b.levels[1][1] ** 2).sum(1)).max(initial=0.0))
    least, most = low - slack, high + slack
    alive, pairs = allowed, None
    for (ma, sa), (mb, sb) in zip(a.levels, b.levels):
        if pairs is None:
            mid, off = ma @ mb.T, sa @ sb.T
            alive &= (mid + off >= least[:, None]) & (mid - off <= most[:, None])
            if np.count_nonzero(alive) < _GATHER * alive.size:
                pairs = np.nonzero(alive)
        else:
            i, j = pairs
            mid, off = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", sa[i], sb[j])
            keep = (mid + off >= least[i]) & (mid - off <= most[i])
            pairs = i[keep], j[keep]
    if pairs is None:
        scores = a.x.astype(kind) @ b.x.astype(kind).T
        i, j = np.nonzero(alive & (scores >= low[:, None]) & (scores <= high[:, None]))
        return i, j, scores[i, j].astype(np.int64)
    i, j = pairs
    scores = np.einsum("ij,ij->i", a.x[i].astype(kind), b.x[j].astype(kind))
    keep = (scores >= low[i]) & (scores <= high[i])
    return i[keep], j[keep], scores[keep].astype(np.int64)


class Best:
    """The best ``k`` rows of each of ``n`` slots: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot, score, ident) -> None:
        slot, score, ident = (np.concatenate(p) for p in zip((self.slot, self.score, self.id), (slot, score, ident)))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        new = np.flatnonzero(np.diff(slot, prepend=-1))
        keep = np.arange(len(slot)) - np.repeat(new, np.diff(np.append(new, len(slot)))) < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ident[keep]

    def floor(self) -> np.ndarray:
        """The k-th best score of each slot, as a double; minus infinity where there are fewer."""
        out = np.full(self.n, -np.inf)
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.n) == self.k)
        np.minimum.at(low := np.full(self.n, np.inf), self.slot, self.score.astype(np.float64))
        out[full] = low[full]
        return out


class Positives:
    """The best rows of an anchor's own label, itself left out."""

    SCHEMA = "anchor_id long, positive_id long, score long"

    def __init__(self, anchors: Side, extra, k: int, kind):
        self.a, self.kind, self.best = anchors, kind, Best(len(anchors.ids), k)

    def scan(self, at: int, a: Side, b: Side) -> None:
        low = self.best.floor()[at:at + len(a.ids)]
        other = (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
        i, j, score = wanted_pairs(a, b, low, np.full(len(low), np.inf), other, self.kind)
        self.best.add(i + at, score, b.ids[j])

    def found(self) -> list[np.ndarray]:
        return [self.a.ids[self.best.slot], self.best.id, self.best.score]


class Negatives:
    """For each positive of an anchor, the best rows of other labels in the positive's band of scores."""

    SCHEMA = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def __init__(self, anchors: Side, extra: list[list[dict]], k: int, kind):
        self.a, self.kind = anchors, kind
        self.p = max((len(e) for e in extra), default=0)
        self.ids, self.scores = np.zeros((len(extra), self.p), np.int64), np.full((len(extra), self.p), -1, np.int64)
        for i, e in enumerate(extra):
            self.ids[i, :len(e)], self.scores[i, :len(e)] = [x["id"] for x in e], [x["score"] for x in e]
        # 50 p <= 100 n <= 95 p in integers; a negative p has no n.
        self.low, self.high = -(-self.scores // 2), self.scores // 100 * 95 + self.scores % 100 * 95 // 100
        self.best = Best(self.scores.size, k)

    def scan(self, at: int, a: Side, b: Side) -> None:
        rows = slice(at, at + len(a.ids))
        low, high = np.maximum(self.low, self.best.floor().reshape(self.low.shape))[rows], self.high[rows]
        usable = self.low[rows] <= high
        least = np.where(usable, low, np.inf).min(1, initial=np.inf)
        most = np.where(usable, high, -np.inf).max(1, initial=-np.inf)
        i, j, score = wanted_pairs(a, b, least, most, a.labels[:, None] != b.labels[None, :], self.kind)
        for p in range(self.p):
            take = (score >= low[i, p]) & (score >= self.low[rows][i, p]) & (score <= high[i, p])
            self.best.add((i[take] + at) * self.p + p, score[take], b.ids[j[take]])

    def found(self) -> list[np.ndarray]:
        i, p = np.divmod(self.best.slot, max(self.p, 1))
        return [self.a.ids[i], self.ids[i, p], self.scores[i, p], self.best.id, self.best.score]


def _side(batch: pa.RecordBatch, d: int) -> Side:
    get = lambda n: batch.column(batch.schema.get_field_index(n))
    matrix = lambda n, t: get(n).flatten().to_numpy(zero_copy_only=False).astype(t).reshape(len(batch), -1)
    return Side(get("vec_id").to_numpy(), get("label").to_numpy(), matrix("v", np.int64), matrix("mean", np.float64), matrix("dev", np.float64))


def _joined(parts: list[Side]) -> Side:
    out = object.__new__(Side)
    out.ids, out.labels, out.x = (np.concatenate([getattr(p, n) for p in parts]) for n in ("ids", "labels", "x"))
    out.levels = [tuple(np.concatenate([p.levels[i][j] for p in parts]) for j in range(2)) for i in range(2)]
    return out


def _stream(search, k: int, kind):
    """Function for ``mapInArrow`` over rows sorted by cell, anchors before rows."""
    names = [f.split()[0] for f in search.SCHEMA.split(", ")]

    def run(batches):
        cell, anchors, extra, work = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            get = lambda n, b=batch: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            keys = np.stack([get(n) for n in ("d", "part", "block", "group", "is_row")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                here, is_row, piece = tuple(keys[start, :4]), keys[start, 4], batch.slice(start, stop - start)
                if here != cell:
                    if work:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in work.found()], names=names)
                    cell, anchors, extra, work = here, [], [], None
                side = _side(piece, keys[start, 0])
                if not is_row:
                    anchors.append(side)
                    extra += piece.column(piece.schema.get_field_index("extra")).to_pylist()
                    continue
                if not anchors:
                    continue
                if work is None:
                    work = search(_joined(anchors), extra, k, kind)
                for lo in range(0, len(side.ids), _ROWS):
                    some = side.cut(slice(lo, lo + _ROWS))
                    for at in range(0, len(work.a.ids), _ANCHORS):
                        work.scan(at, work.a.cut(slice(at, at + _ANCHORS)), some)
        if work:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in work.found()], names=names)

    return run


def _searched(rows: DataFrame, anchors: DataFrame, search, k: int, kind) -> DataFrame:
    """Run one pass: rows and anchors (with an array ``extra``) of equal ``d, part`` meet in cells.

    ``part`` splits the search (the label, or nothing). Every row goes to each
    block of anchors of its part, every anchor to each group of rows.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n, a = (t.groupBy("d", "part").agg(F.count(F.lit(1)).alias(c)) for t, c in ((rows, "n"), (anchors, "a")))
    # Whole numbers of groups and blocks per part; more groups than memory asks for only to use the cores.
    sizes = written(n.join(a, ["d", "part"]).select(
        "d", "part", F.greatest(F.ceil(F.col("n") / GROUP), F.least(F.lit(2 * cores), F.ceil(F.col("n") / LEAST))).cast("long").alias("groups"),
        F.ceil(F.col("a") / BLOCK).cast("long").alias("blocks")), "sizes")
    cells = sizes.agg(F.sum(F.col("groups") * F.col("blocks")).alias("c")).first()["c"] or 1
    dealt = lambda of: F.pmod(F.xxhash64("vec_id"), of)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    given = ["d", "part", "vec_id", "label", "v", "mean", "dev"]
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    left = rows.join(sizes, ["d", "part"]).select(*given, none.alias("extra"), F.lit(1).cast("long").alias("is_row"), dealt("groups").alias("group"), every("blocks").alias("block"))
    right = anchors.join(sizes, ["d", "part"]).select(*given, "extra", F.lit(0).cast("long").alias("is_row"), every("groups").alias("group"), dealt("blocks").alias("block"))
    cell = ["d", "part", "block", "group"]
    placed = left.unionByName(right).repartition(int(min(max(cells, cores), 100_000)), *cell).sortWithinPartitions(*cell, "is_row")
    return placed.mapInArrow(_stream(search, k, kind), search.SCHEMA)


def _summarised(rows: DataFrame) -> DataFrame:
    """Rows with their length and the stored summaries of their fine segments."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column(batch.schema.get_field_index("v"))
            d = np.diff(v.offsets.to_numpy())
            for n in np.unique(d):
                take = batch.take(pa.array(np.flatnonzero(d == n)))
                x = take.column(take.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                mean, dev = summarise(x, FINE)
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(np.full(len(x), n, np.int64)), pa.array(list(mean)), pa.array(list(dev))], names=[*take.schema.names, "d", "mean", "dev"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<int>, d long, mean array<double>, dev array<double>")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Where an id is
    divisible by ``shift_every``, its label first becomes ``(label + 1) % labels``.
    """
    shifted = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = written(_summarised(integers(vectors).withColumn("label", shifted)), "rows")
    # Doubles hold all partial sums exactly up to 2^53; larger components take slower integers.
    widest = rows.agg(F.max(F.col("d") * F.pow(F.greatest(F.array_max("v"), -F.array_min("v")).cast("double"), F.lit(2.0))).alias("w")).first()["w"]
    kind = np.float64 if (widest or 0) < 2.0**53 else np.int64
    anchors = rows.where(F.col("vec_id") % every == 0)
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    first = _searched(rows.withColumn("part", F.col("label")), anchors.withColumns({"part": F.col("label"), "extra": none}), Positives, positives, kind)
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    best = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= positives)
    pairs = written(best.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("extra")), "positives")
    nothing = F.lit(0).cast("long")
    chosen = anchors.join(pairs, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id").withColumn("part", nothing)
    found = _searched(rows.withColumn("part", nothing), chosen, Negatives, negatives, kind)
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

"""Nearest neighbours by adaptive dimension scan over inverted lists.

Largest inner product is turned into smallest distance by one more dimension
(the root of the largest squared norm less the vector's own). Vectors are rotated
by a random orthogonal matrix and laid out in blocks of columns. Within each
probed list the distance to all candidates is summed block by block, and a test
on the partial sum abandons candidates that are unlikely to come below the
query's threshold. What survives is scored in double precision on the original
vectors.

Vectors that are null, zero, hold null or non-finite components, or differ from
the most common length take no part; null ids neither. Rows that repeat an id and
its vector count once; of several vectors of one id the first in array order
stays. Ties go to the smaller id. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE = 20_000
MAX_LISTS = 16_384
CELL_ROWS = 4096
COLUMNS = 16
EPSILON = 2.1
# Share of the true neighbours that the probed lists should hold, measured on so many vectors.
COVER = 0.96
MEASURED = 200


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors that take part, as double arrays."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1)
    n = common.first()
    rows = rows.where(F.size("v") == (n["n"] if n else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


class Index:
    """Rotation, list centres and the sample that thresholds come from."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, rows: int, top_norm: float, k: int, seed: int = 5):
        self.k, self.norm = k, top_norm
        self.ids, self.sample = sample_ids, sample
        self.turn = rotation(sample.shape[1] + 1, seed)
        x = self.rotated(sample)
        lists = int(min(MAX_LISTS, max(1, round(2 * rows**0.5)), len(x)))
        r = np.random.default_rng(seed)
        centres = x[np.sort(r.choice(len(x), lists, replace=False))]
        for _ in range(8):
            own = self.nearest(x, centres)
            total = np.zeros_like(centres)
            np.add.at(total, own, x)
            n = np.bincount(own, minlength=lists)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        self.centres = centres
        self.probes = lists

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]]) @ self.turn

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = (centres * centres).sum(1) / 2
        return np.concatenate([(x[i:i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists from near to far for each rotated query."""
        return np.argsort((self.centres * self.centres).sum(1) / 2 - q @ self.centres.T, axis=1, kind="stable")

    def enough(self, q: np.ndarray, lists: list[np.ndarray], cover: float = COVER) -> int:
        """Lists to probe so that ``cover`` of the true neighbours of ``q`` lie in them;
        ``lists`` holds the list of each neighbour."""
        rank = np.argsort(self.order(self.rotated(q, True)), axis=1)
        found = np.sort(np.concatenate([rank[i, own] for i, own in enumerate(lists)]))
        return int(found[min(len(found) - 1, int(np.ceil(cover * len(found))))]) + 1 if len(found) else len(self.centres)

    def thresholds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner product of the 2k-th best sample vector, so that k better ones are
        found though some lists are not probed."""
        s = q @ self.sample.T
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        if s.shape[1] <= 2 * self.k:
            return np.full(len(q), -np.inf)
        return np.partition(s, -2 * self.k, axis=1)[:, -2 * self.k]


def build(rows: DataFrame, k: int) -> tuple[Index, np.ndarray, np.ndarray] | None:
    """Index fit on at most ``SAMPLE`` vectors (by the hash of the id; every vector is indexed
    later), and ids and vectors of the ``MEASURED`` rows that follow them in that order.

    A vector of the fit has a list centre near it that others lack, so the rows to
    measure by are others as far as there are any.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not facts["n"]:
        return None
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE + MEASURED).toPandas()
    ids, x = got["vec_id"].to_numpy(dtype=np.int64), np.stack(got["v"].to_numpy()).astype(np.float64)
    return Index(ids[:SAMPLE], x[:SAMPLE], facts["n"], facts["m"], k), ids[-MEASURED:], x[-MEASURED:]


def true_lists(listed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """Lists of the k nearest of all rows for each vector of ``q``, by comparing all of them.

    A task keeps the k best for each vector, so it emits one row per vector whatever it reads.
    """
    def best(score: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.lexsort((own, -score))[:rows]

    def compare(batches):
        top = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))] * len(ids)
        for b in batches:
            if not len(b):
                continue
            own, lists = b["vec_id"].to_numpy(dtype=np.int64), b["list"].to_numpy(dtype=np.int32)
            scores = q @ np.stack(b["v"].to_numpy()).astype(np.float64).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            for i, s in enumerate(scores):
                # All that tie with the k-th stay until the ids decide.
                at = np.flatnonzero((s >= np.partition(s, -k)[-k] if len(s) > k else True) & (s > -np.inf))
                at = at[best(s[at], own[at], k)]
                three = [np.concatenate(c) for c in zip(top[i], (s[at], own[at], lists[at]))]
                keep = best(three[0], three[1], k)
                top[i] = tuple(c[keep] for c in three)
        yield pd.DataFrame({"q": np.arange(len(ids), dtype=np.int32), "score": [t[0] for t in top], "vec_id": [t[1] for t in top], "list": [t[2] for t in top]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        score, own, lists = (np.concatenate(rows[c].to_numpy()) for c in ("score", "vec_id", "list"))
        return pd.DataFrame({"q": rows["q"].iloc[0], "list": lists[best(score, own, k)]})

    parts = listed.mapInPandas(compare, "q int, score array<double>, vec_id array<long>, list array<int>").where(F.size("list") > 0)
    got = parts.groupBy("q").applyInPandas(merge, "q int, list int").toPandas()
    return [got["list"].to_numpy(dtype=np.int64)[got["q"].to_numpy() == i] for i in range(len(ids))]


def scan(index: Index, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """Scan one list for several queries: pairs (query row, candidate row, score).

    ``least`` holds each query's threshold as an inner product.
    """
    r, t = index.rotated(x), index.rotated(q, True)
    d = r.shape[1]
    # distance^2 = |q|^2 + norm - 2 * inner product; a hair of slack keeps ties.
    limit = (q * q).sum(1) + index.norm - 2 * least
    limit = limit + np.where(np.isfinite(limit), 1e-9 * (1 + np.abs(limit)), 0.0)
    blocks = [np.ascontiguousarray(r[:, a:a + COLUMNS]) for a in range(0, d, COLUMNS)]
    out = []
    for at in range(0, len(t), 512):
        part, bound = t[at:at + 512], limit[at:at + 512]
        first = blocks[0]
        near = (part[:, :COLUMNS] ** 2).sum(1)[:, None] + (first * first).sum(1)[None, :] - 2 * part[:, :COLUMNS] @ first.T
        seen = min(COLUMNS, d)
        test = bound * (seen / d) * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else bound
        qi, ci = np.nonzero(near <= test[:, None])
        sums = near[qi, ci]
        for b, block in enumerate(blocks[1:], start=1):
            lo = b * COLUMNS
            gap = part[qi, lo:lo + COLUMNS] - block[ci]
            sums = sums + np.einsum("ij,ij->i", gap, gap)
            seen = min(lo + COLUMNS, d)
            test = bound * (seen / d) * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else bound
            keep = sums <= test[qi]
            qi, ci, sums = qi[keep], ci[keep], sums[keep]
        qi = qi + at
        other = q_ids[qi] != ids[ci]
        qi, ci = qi[other], ci[other]
        out.append((qi, ci, np.einsum("ij,ij->i", q[qi], x[ci])))
    return [np.concatenate(a) for a in zip(*out)] if out else [np.empty(0, int)] * 2 + [np.empty(0)]


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each id divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(clean(vectors), "vectors")
    built = build(rows, k)
    if built is None:
        return empty
    index, measured_ids, measured = built

    def assign(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"vec_id": b["vec_id"], "list": index.nearest(index.rotated(x), index.centres).astype(np.int32), "v": b["v"]})

    def probe(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                q = np.stack(part["v"].to_numpy()).astype(np.float64)
                lists = index.order(index.rotated(q, True))[:, :index.probes].astype(np.int32)
                least = index.thresholds(part["vec_id"].to_numpy(dtype=np.int64), q)
                yield pd.DataFrame({"query_id": part["vec_id"], "least": least, "lists": list(lists), "q": part["v"]})

    listed = written(rows.mapInPandas(assign, "vec_id long, list int, v array<double>"), "lists")
    index.probes = index.enough(measured, true_lists(listed, measured_ids, measured, k))
    queries = rows.where(F.col("vec_id") % every == 0)
    probed = written(queries.mapInPandas(probe, "query_id long, least double, lists array<int>, q array<double>"), "probes")
    found = written(_scanned(index, listed, probed, k), "found")
    # Queries that found too few in the probed lists scan all lists without a threshold.
    total = rows.count()
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, total - 1))
    all_lists = F.array(*[F.lit(i) for i in range(len(index.centres))]).cast("array<int>")
    short = probed.join(enough, "query_id", "left_anti").select("query_id", F.lit(float("-inf")).alias("least"), all_lists.alias("lists"), "q")
    short = written(short, "short")
    if not short.isEmpty():
        found = found.join(enough, "query_id", "left_semi").unionByName(_scanned(index, listed, short, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanned(index: Index, listed: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each list for each query that probes it.

    Lists and the queries of a list are cut into cells of about ``CELL_ROWS`` rows
    each, so a hot list is spread; the table of list sizes has at most ``MAX_LISTS`` rows.
    """
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = probed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    cells = F.broadcast(sizes.join(asked, "list").select(
        "list", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("cn"), F.ceil(F.col("m") / CELL_ROWS).cast("int").alias("qn")))
    left = listed.join(cells, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "cn").cast("int").alias("c"), F.explode(F.expr("sequence(0, qn - 1)")).alias("s"), "vec_id", "v")
    right = probed.select("query_id", "least", "q", F.explode("lists").alias("list")).join(cells, "list").select(
        "list", F.explode(F.expr("sequence(0, cn - 1)")).alias("c"), F.pmod(F.xxhash64("query_id"), "qn").cast("int").alias("s"), "query_id", "least", "q")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, q_ids = a["vec_id"].to_numpy(dtype=np.int64), b["query_id"].to_numpy(dtype=np.int64)
        qi, ci, score = scan(index, ids, np.stack(a["v"].to_numpy()).astype(np.float64), q_ids, np.stack(b["q"].to_numpy()).astype(np.float64), b["least"].to_numpy(dtype=np.float64))
        got = pd.DataFrame({"query_id": q_ids[qi], "vec_id": ids[ci], "score": score}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return got.groupby("query_id").head(k)

    return left.groupBy("list", "c", "s").cogroup(right.groupBy("list", "c", "s")).applyInPandas(meet, "query_id long, vec_id long, score double")

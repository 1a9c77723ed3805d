"""Centroid clustering by equal-average equal-variance search, in exact integers.

Each component x becomes floor(256 x). The search for the nearest centroid keeps
the centroids sorted by the sum of their components and scans outward from the
vector's own sum, the nearer side first. With d components, sums S and spreads
V = sqrt(d sum(x^2) - S^2),

    d * distance >= (S_x - S_c)^2 + (V_x - V_c)^2.

The first term ends the scan, both terms reject a centroid, and what is left gets
its exact integer distance. Ties go to the smaller number.

Vectors with another number of components, null, or with null or non-finite
components take no part, nor do those with an integer component of 2^27 or more
(their distances are no longs). Repeated rows count as often as they stand there;
rows without an id are clustered but are no first centroids. Fewer vectors than
centroids give fewer centroids; an empty table gives no rows.

Only centroids reach the driver, ``k`` rows a round; a task sends one row of sums
for each centroid it met, whatever it reads.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import attach_row
from .common import written

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LIMIT = 2.0**27
# Room for rounding of the bounds in double precision; distances are exact.
_SLACK = 1e-9


def integers(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as integer arrays."""
    v = F.col("embedding").cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / SCALE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == components) & F.forall("v", fits))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("int")).alias("x"))


class Search:
    """Nearest centroid of many vectors."""

    def __init__(self, centroids: np.ndarray):
        self.number = np.argsort(centroids.sum(1), kind="stable")
        self.sorted = centroids[self.number]
        self.sums, self.spreads = self.measures(self.sorted)

    @staticmethod
    def measures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x.sum(1).astype(np.float64)
        # d sum(x^2) - S^2 as a sum of squares: no cancellation.
        return s, np.sqrt(x.shape[1]) * np.sqrt(((x - s[:, None] / x.shape[1]) ** 2).sum(1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance, for rows of int64."""
        n, d, k = len(x), x.shape[1], len(self.sums)
        s, v = self.measures(x)
        high = np.searchsorted(self.sums, s)
        low = high - 1
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        open_ = np.arange(n)
        while len(open_):
            lo, hi = low[open_], high[open_]
            below = np.where(lo >= 0, s[open_] - self.sums[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s[open_], np.inf)
            up = above < below
            gap, at = np.where(up, above, below), np.where(up, hi, lo)
            limit = d * best[open_].astype(np.float64) * (1 + _SLACK) + _SLACK
            # The nearer side is too far: so is all that lies further out.
            go = (gap * gap <= limit) & np.isfinite(gap)
            open_, at, up, gap, limit = open_[go], at[go], up[go], gap[go], limit[go]
            near = gap * gap + (v[open_] - self.spreads[at]) ** 2 <= limit
            rows, c = open_[near], at[near]
            apart = x[rows] - self.sorted[c]
            dist, num = np.einsum("ij,ij->i", apart, apart), self.number[c]
            better = (dist < best[rows]) | ((dist == best[rows]) & (num < who[rows]))
            best[rows[better]], who[rows[better]] = dist[better], num[better]
            high[open_[up]] += 1
            low[open_[~up]] -= 1
        return who, best


def _matrix(batch: pa.RecordBatch, components: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    search, (k, d) = Search(centroids), centroids.shape

    def sums(batches):
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            who, _ = search.nearest(x)
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(met, pa.int32()), "n": pa.array(count[met], pa.int64()),
            "total": pa.array(list(total[met]), pa.list_(pa.int64()))})

    parts = rows.mapInArrow(sums, "cluster int, n long, total array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = parts.select("cluster", "n", F.posexplode("total").alias("i", "t")).groupBy("cluster", "i").agg(exact("n").alias("n"), exact("t").alias("t"))
    out = centroids.copy()
    for r in got.collect():  # at most k * d rows
        out[r["cluster"], r["i"]] = int(r["t"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each vector."""
    spark = vectors.sparkSession
    rows = written(integers(vectors, components), "integers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(order, "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, components)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(rows, centroids)
    search = Search(centroids)

    def assign(batches):
        for batch in batches:
            who, dist = search.nearest(_matrix(batch, components))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "cluster": pa.array(who, pa.int32()), "distance": pa.array(dist, pa.int64())})

    assigned = written(rows.select("vec_id", "x").mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # One row per centroid on the other side of both joins, so at most k.
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = attach_row(inertia, assigned.agg(F.sum("distance").alias("inertia")))
    facts = inertia.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min((q + cq - 2 * list_dot_product(x, cx)) * 64 + c) AS best
    FROM v, c{i} GROUP BY r)"""


def _moved_sql(i: int) -> str:
    return f"""m{i} AS (SELECT c, list(m ORDER BY j) AS x FROM (SELECT (best % 64)::INT AS c, j, floor(sum(x[j]) / count(*)) AS m
    FROM a{i - 1}, unnest(range(1, {COMPONENTS + 1})) AS u(j) GROUP BY 1, 2) GROUP BY c),
c{i} AS MATERIALIZED (SELECT c, cx, list_dot_product(cx, cx) AS cq FROM (SELECT p.c, coalesce(m{i}.x, p.cx) AS cx FROM c{i - 1} p LEFT JOIN m{i} ON p.c = m{i}.c))"""


# SQL twin: doubles hold these integers exactly; distance and number (under 64) are compared as one number.
ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x, list_dot_product(x, x) AS q FROM (
    SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS x FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, x AS cx, list_dot_product(x, x) AS cq
    FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {CENTROIDS})),
{_round_sql(0)},
{(',' + chr(10)).join(_moved_sql(i) + ',' + chr(10) + _round_sql(i) for i in range(1, ROUNDS + 1))},
s AS (SELECT vec_id, (best % 64)::INT AS cluster, ((best - best % 64) / 64)::BIGINT AS distance FROM a{ROUNDS}),
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM s GROUP BY 1)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM s) AS inertia,
    sha256(array_to_string(list_transform(cx, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM s JOIN i USING (cluster) JOIN c{ROUNDS} ON cluster = c"""

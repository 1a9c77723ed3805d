"""Quartile bucket digests: fingerprints of whole texts and their difference.

Bytes are read in windows of five; six byte triplets of each window are hashed
and counted in ``BUCKETS`` buckets. The digest holds a length code and, for each
bucket, the quartile of its count. The difference of two digests adds bucket
steps and the gap of the length codes and is bounded; likeness is 1 minus its
share of the bound.

Null is read as empty; texts below five bytes are padded, so each text has a
digest. Equal texts have equal digests; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BUCKETS = 256
# Three random words for each byte value, and the places of the six triplets.
_WORDS = np.random.default_rng(20).integers(1, 2**32, size=(3, 256), dtype=np.uint32)
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)
# Unequal quartiles cost their distance, opposite ends twice as much.
_STEP = np.array([0, 1, 2, 6])
# Mean of _STEP over independent quartiles times the buckets: as far as unrelated texts are apart.
BOUND = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
_LENGTH_WEIGHT = 2
_LENGTH_MOST = 32


def digest(raw: bytes) -> np.ndarray:
    """Length code, then one quartile (0 to 3) for each bucket."""
    data = np.frombuffer(raw.ljust(5, b"\0"), dtype=np.uint8)
    a, b, c = _WORDS[0][data], _WORDS[1][data], _WORDS[2][data]
    n = len(data) - 4
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for (i, j, k), mix in zip(_TRIPLETS, _MIX):
        h = a[i:i + n] + b[j:j + n]
        h += c[k:k + n]
        h *= mix
        h >>= np.uint32(24)
        counts += np.bincount(h, minlength=BUCKETS)
    ordered = np.sort(counts)
    quarter = BUCKETS // 4
    cuts = ordered[[quarter - 1, 2 * quarter - 1, 3 * quarter - 1]]
    code = min(255, int(8 * np.log2(1 + len(raw))))
    return np.concatenate([[code], (counts[:, None] > cuts).sum(1)]).astype(np.uint8)


def to_text(d: np.ndarray) -> str:
    q = d[1:].reshape(-1, 4)
    return f"{d[0]:02x}" + (q[:, 0] * 64 + q[:, 1] * 16 + q[:, 2] * 4 + q[:, 3]).astype(np.uint8).tobytes().hex()


def difference(x: np.ndarray, y: np.ndarray) -> float:
    steps = _STEP[np.abs(x[1:].astype(np.int16) - y[1:])].sum()
    return float(steps + _LENGTH_WEIGHT * min(_LENGTH_MOST, abs(int(x[0]) - int(y[0]))))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal digests, 0 from the bound on."""
    return max(0.0, 1.0 - difference(x, y) / BOUND)


def _routes(docs: DataFrame, parts: int) -> tuple[list[int], int | None]:
    """Ids that begin a part (the first row of this id goes to the part before as well), and the smallest id."""
    steps = [i / parts for i in range(1, parts)] or [0.5]
    row = docs.agg(F.percentile_approx("doc_id", steps, 10_000).alias("q"), F.min("doc_id").alias("least")).first()
    least = row["least"]
    return sorted({q for q in row["q"] or [] if q > least}) if parts > 1 else [], least


def with_next(docs: DataFrame, fn, schema: str, parts: int | None = None) -> DataFrame:
    """Walk the rows in order of ``doc_id`` with each row's successor at hand.

    The text is shuffled once: ids are cut into ranges, each range is one
    partition, and only the row that begins a range is sent twice, to the range
    before it as well (the first row of all to the last range). ``fn`` gets
    ``(rows, next row)`` batches and returns columns.

    Rows of one id are ordered by the digest of their text; a null id comes
    first. The successor of the last row is the first row.
    """
    import pyarrow as pa
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    begins, least = _routes(base.select(F.col("_id").alias("doc_id")), parts)
    last = len(begins)

    @pandas_udf("int")
    def part(ids):
        import pandas as pd
        return pd.Series(np.searchsorted(np.array(begins, dtype=np.int64), ids.to_numpy(), side="right").astype(np.int32))

    # The first row of each range, one per id however often it stands there, goes to
    # the range before as well; the first of all to the last range.
    heads = {i: (at, 1) for at, i in enumerate(begins)} | ({least: (last, 2)} if least is not None else {})
    first = base.where(F.col("_id").isin(*heads)).groupBy("_id").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.xxhash64("text"), "text")).alias("_row"))
    where = spark.createDataFrame([(i, at, tail) for i, (at, tail) in heads.items()], "_id long, _part int, _tail int")
    tails = first.join(F.broadcast(where), "_id").select("_row.doc_id", "_row.text", "_id", "_part", "_tail")
    sent = base.select("doc_id", "text", "_id", part("_id").alias("_part"), F.lit(0).alias("_tail")).unionByName(tails)
    placed = sent.repartitionById(last + 1, F.col("_part")).sortWithinPartitions("_tail", "_id", F.xxhash64("text"))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def walk(batches):
        held = None
        for batch in batches:
            ids, texts, tails = (batch.column(i).to_pylist() for i in range(3))
            body = [i for i, t in enumerate(tails) if not t]
            ends = [i for i, t in enumerate(tails) if t]
            if body:
                rows = [(ids[i], texts[i]) for i in body]
                for row in rows:
                    if held is not None:
                        yield from fn(held, row)
                    held = row
            if ends and held is not None:
                yield from fn(held, (ids[ends[0]], texts[ends[0]]))
                held = None

    def run(batches):
        out: list[dict] = []
        size = 0
        for row in walk(batches):
            out.append(row)
            size += 1
            if size == 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return placed.select("doc_id", "text", "_tail").mapInArrow(run, schema)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Digests of each text, of its edited text (second half taken from the next
    document) and of the next document, and how near they are."""
    def one(row, after):
        doc_id, text = row
        n, half = len(text), len(text) // 2
        edited = (text[:n - half] + after[1][:half]).encode("utf-8", "surrogatepass")
        own, changed, other = digest(text.encode("utf-8", "surrogatepass")), digest(edited), digest(after[1].encode("utf-8", "surrogatepass"))
        yield {
            "doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": to_text(own),
            "edited_fingerprint": to_text(changed), "near_edited": likeness(own, changed), "near_next": likeness(own, other),
        }

    return with_next(docs, one, RESULT, parts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; needs no shuffle."""
    from .common import chunks, texts_of

    def run(batch):
        for part in chunks([batch], "text"):
            yield {"doc_id": part.column(0), "fingerprint": [to_text(digest(t.encode("utf-8", "surrogatepass"))) for t in texts_of(part)]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string")

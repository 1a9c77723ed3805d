"""Line dedup by overlapping windows of three lines.

Each three consecutive lines of a text are hashed (128 bits). A window that was
seen before, in the order of document id and position, covers its three lines;
covered positions are merged into runs and taken out. The first occurrence of a
window always stays.

Null ids come first in that order, a null text is empty, texts of fewer than three
lines have no window. Rows that repeat an id and its text are one document and
get the same result. A text may end empty; its row stays. Columns and rows are kept.
Only DataFrame functions; a hot window is counted with partial aggregates, and the
join back to its occurrences has one row per window on the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .pii import let

WINDOW = 3


def _windows(text: Column) -> Column:
    """Array of two 64-bit hashes per window."""
    def hashed(salt: int):
        return lambda x: F.transform(x, lambda s: F.xxhash64(s, F.lit(salt)))

    def build(h: Column, g: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        one = lambda i: F.struct(
            F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]).alias("a"), F.xxhash64(*[F.get(g, i + j) for j in range(WINDOW)]).alias("b"))
        return F.when(F.size(h) >= WINDOW, F.transform(at, one))

    return let(F.split(text, "\n"), lambda x: let(hashed(1)(x), lambda h: let(hashed(2)(x), lambda g: build(h, g))))


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated windows taken out of ``text``, and the number of
    lines before and after in ``_lines`` and ``_kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_k", _text_key(body))
    seen = written(keyed.select("_id", "_k", F.posexplode(_windows(body)).alias("pos", "w")).select("_id", "_k", "pos", "w.a", "w.b"), "line-windows")
    place = F.struct("_id", "_k", "pos")
    first = seen.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    later = seen.join(first, ["a", "b"]).where(place != F.col("_first"))
    covered = later.groupBy("_id", "_k").agg(F.sort_array(F.collect_set("pos")).alias("_pos")).withColumnsRenamed({"_id": "_cid", "_k": "_ck"})
    joined = keyed.join(covered, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_k") == F.col("_ck")), "left")

    def kept(lines: Column, pos: Column) -> Column:
        """Lines outside the runs of covered positions: slices between the runs."""
        starts = F.filter(pos, lambda p, i: (i == 0) | (p > F.get(pos, i - 1) + WINDOW))
        stops = F.filter(pos, lambda p, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) > p + WINDOW))
        begin = F.concat(F.array(F.lit(0)), F.transform(stops, lambda p: p + WINDOW))
        end = F.concat(starts, F.array(F.size(lines)))
        return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(lines, b + 1, F.greatest(e - b, F.lit(0)))))

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = joined.withColumn("_out", F.when(F.col("_pos").isNotNull(), let(lines, lambda x: kept(x, F.col("_pos")))))
    return out.withColumn("_lines", F.size(lines)).withColumn("_kept", F.when(F.col("_pos").isNotNull(), F.size("_out")).otherwise(F.col("_lines"))).withColumn(
        text, F.when(F.col("_pos").isNotNull(), F.array_join("_out", "\n")).otherwise(F.col(text))).select(*docs.columns, "_lines", "_kept")


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents}),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM d, unnest(range(1, len(l) - 1)) AS u(i)),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m WHERE n > 1) GROUP BY doc_id),
o AS (SELECT d.doc_id, d.text, len(l) AS n_lines, ps, list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: NOT coalesce(list_contains(ps, x[2]), false)) AS kept
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
"""

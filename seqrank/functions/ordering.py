"""Running totals and positions inside groups of any size.

A window ``partitionBy(group).orderBy(value)`` sends a whole group to one
task. That is a good plan for ordinary groups, but one group may hold a third
of all rows. :func:`running_before` therefore gives the order as *levels* from
coarse to fine: totals are built bottom-up by ordinary aggregation and each
window only spans the children of one coarse cell. Row positions take the plain
window for groups up to ``WINDOW_ROWS`` rows and the levels for larger ones.
Both ways are exact and do not depend on sampling, so a lost executor can
recompute any part. Several positions of a larger group are sorted as ranges,
which are written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

# Cells per unit of natural log, and the smallest magnitude that is resolved.
_CELLS_PER_LOG = 16384.0
_MAGNITUDE_SCALE = 2.0**40

# Largest group that one window may hold. At most rows / WINDOW_ROWS groups are
# larger, which bounds the broadcast list of their keys (a trillion rows: 250
# thousand keys).
WINDOW_ROWS = 4_000_000


def magnitude_cell(c: Column) -> Column:
    """A monotone integer cell of a numeric value (about 11k cells per octave).

    Only monotonicity matters: the logarithm of the JVM is semi-monotonic, so
    values in order fall into cells in order.
    """
    v = c.cast("double")
    cell = F.floor(F.log1p(F.abs(v) * F.lit(_MAGNITUDE_SCALE)) * F.lit(_CELLS_PER_LOG))
    return F.when(v < 0, -cell).otherwise(cell)


def _cells(t: T.DataType, name: str, digest: bool = False) -> list[tuple[str, Column]]:
    """Coarse cells above a value: prefixes of text (one of 65 536 cells for a digest,
    a second, longer one for keys with a common beginning), the day of a time, the
    magnitude cell of a number."""
    c = F.col(name)
    if isinstance(t, T.StringType):
        return [(f"p{n}", F.substring(c, 1, n)) for n in ((4,) if digest else (4, 12))]
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return [("day", F.date_trunc("day", c))]
    if isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.DateType)):
        return []
    return [("cell", magnitude_cell(c))]


def order_levels(df: DataFrame, columns: Sequence[str], prefix: str = "_lv", digests: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Add level columns for a sort order and return their names, coarse to fine.
    Columns in ``digests`` are known to be spread evenly.

    The first two sort columns get cells of their own, so neither may hold a
    hot value that ends in one window; further columns only break ties of the
    second one.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    first, *rest = columns
    added = [(f"{prefix}0_{tag}", c) for tag, c in _cells(types[first], first, first in digests)]
    levels = [n for n, _ in added] + [first]
    if rest:
        finer = [(f"{prefix}1_{tag}", c) for tag, c in _cells(types[rest[0]], rest[0], rest[0] in digests)]
        tail = (f"{prefix}1_tail", F.struct(*[F.col(c) for c in rest])) if len(rest) > 1 else None
        added += finer + ([tail] if tail else [])
        levels += [n for n, _ in finer] + [tail[0] if tail else rest[0]]
    return df.select("*", *[c.alias(n) for n, c in added]), levels


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    ``row`` must come from an aggregate without grouping, so the broadcast side
    is one row by construction.
    """
    key = "_one_row"
    return df.withColumn(key, F.lit(0)).join(F.broadcast(row.withColumn(key, F.lit(0))), key, "left").drop(key)


def group_key(groups: Sequence[str]) -> Column:
    """All group columns as one struct: never null itself, nulls inside are equal.

    Joins on a struct add no ``IS NOT NULL`` filters, so the branches of a plan
    that read the same shuffle stay identical and Spark reuses it.
    """
    return F.struct(*[F.col(c) for c in groups]) if groups else F.struct(F.lit(0).alias("all"))


def _earlier(w: str, order: Sequence[str]) -> Column:
    span = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(w).over(span), F.lit(0))


def _plain_running(df: DataFrame, levels: list[str], weights: list[str], totals: bool) -> DataFrame:
    """One window per group; ``df`` carries its group as ``_k``."""
    return df.select(
        "*",
        *[_earlier(w, levels).alias(f"before_{w}") for w in weights],
        *([F.sum(w).over(Window.partitionBy("_k")).alias(f"total_{w}") for w in weights] if totals else []),
    )


def _leveled_running(df: DataFrame, groups: list[str], levels: list[str], weights: list[str], totals: bool) -> DataFrame:
    """Windows over the children of one coarse cell each."""
    columns, coarse = {len(levels): df.columns}, {len(levels): df}
    for depth in range(len(levels) - 1, 0, -1):
        keys = groups + levels[:depth]
        coarse[depth] = coarse[depth + 1].groupBy(*keys).agg(*[F.sum(w).alias(w) for w in weights])
        columns[depth] = keys + weights
    out = _plain_running(coarse[1].withColumn("_k", group_key(groups)), levels[:1], weights, totals)
    for depth in range(2, len(levels) + 1):
        keys = groups + levels[: depth - 1]
        carried = [F.col(f"total_{w}") for w in weights] if totals else []
        up = out.select(group_key(keys).alias("_k"), *[F.col(f"before_{w}").alias(f"_up_{w}") for w in weights], *carried)
        out = coarse[depth].withColumn("_k", group_key(keys)).join(up, "_k").select(
            *columns[depth],
            *[(F.col(f"_up_{w}") + _earlier(w, levels[depth - 1 : depth])).alias(f"before_{w}") for w in weights],
            *carried,
        )
    return out


def running_before(
    df: DataFrame,
    groups: Sequence[str],
    levels: Sequence[str],
    weights: Sequence[str],
    totals: bool = True,
    split: bool = False,
    window_rows: int | None = None,
) -> DataFrame:
    """Add ``before_<w>`` (sum over strictly earlier cells) and ``total_<w>``.

    ``df`` holds one row per ``groups + levels``; other columns are carried
    along. Without ``split`` every group goes through the levels and the input
    is read once, which suits histograms that come out of a longer plan. With
    ``split`` only groups above ``window_rows`` (``WINDOW_ROWS``) do; that reads the input again
    for the counts, which suits rows that come straight from a table. With
    adaptive execution the leveled branch disappears when no group is large.
    """
    groups, levels, weights = list(groups), list(levels), list(weights)
    added = [f"before_{w}" for w in weights] + ([f"total_{w}" for w in weights] if totals else [])
    keyed = df.withColumn("_k", group_key(groups))
    if len(levels) == 1:
        return _plain_running(keyed, levels, weights, totals).select(*df.columns, *added)
    if not split:
        return _leveled_running(df, groups, levels, weights, totals).select(*df.columns, *added)
    large = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > (WINDOW_ROWS if window_rows is None else window_rows)).select("_k")
    small = _plain_running(keyed.join(F.broadcast(large), "_k", "left_anti"), levels, weights, totals)
    deep = _leveled_running(keyed.join(F.broadcast(large), "_k", "left_semi").drop("_k"), groups, levels, weights, totals)
    return small.select(*df.columns, *added).unionByName(deep.select(*df.columns, *added))


def with_position(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    total: str | None = None,
    digests: Sequence[str] = (),
    window_rows: int | None = None,
) -> DataFrame:
    """0-based position of every row inside its group under a *total* order.

    ``order`` must identify rows inside the group (the last column breaks all
    ties). ``window_rows`` overrides the size above which a group takes the levels.
    """
    one = "_one"
    leveled, levels = order_levels(df.withColumn(one, F.lit(1).cast("long")), order, digests=digests)
    placed = running_before(leveled, groups, levels, [one], totals=total is not None, split=True, window_rows=window_rows)
    extra = [F.col(f"total_{one}").alias(total)] if total else []
    return placed.select(*[F.col(c) for c in df.columns], F.col(f"before_{one}").cast("long").alias(name), *extra)


def with_positions(
    df: DataFrame,
    groups: Sequence[str],
    orders: Mapping[str, Sequence[str]],
    total: str | None = None,
    window_rows: int | None = None,
) -> DataFrame:
    """Several positions like :func:`with_position`, one column per entry of ``orders``.

    An order may name a position before it. Groups up to ``window_rows`` go
    through one shuffle and are sorted once per order; larger ones are sorted as
    ranges, one order after another. Starts a job that counts the groups.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    columns = [*df.columns, *orders, *([total] if total else [])]
    keyed = df.withColumn("_k", group_key(groups))

    def windows(rows: DataFrame) -> DataFrame:
        for name, order in orders.items():
            rows = rows.withColumn(name, F.row_number().over(Window.partitionBy("_k").orderBy(*order)).cast("long") - 1)
        if total:
            rows = rows.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy("_k")))
        return rows.select(*columns)

    large = keyed.groupBy("_k").agg(F.count(F.lit(1)).cast("long").alias("_rows")).filter(F.col("_rows") > limit)
    # Asked for first: most data have no such group.
    if large.isEmpty():
        return windows(keyed)
    checkpoint_dir(df.sparkSession)
    large = F.broadcast(large.checkpoint())
    # Ranges are found by a sample and then sorted, so the rows are read twice.
    deep = keyed.join(large, "_k").checkpoint()
    for name, order in orders.items():
        placed = with_row_index(deep.orderBy("_k", *order), name="_at")
        starts = placed.groupBy("_k").agg(F.min("_at").alias("_from"))
        deep = placed.join(F.broadcast(starts), "_k").withColumn(name, F.col("_at") - F.col("_from")).drop("_at", "_from")
    deep = deep.withColumn(total, F.col("_rows")) if total else deep
    return windows(keyed.join(large, "_k", "left_anti")).unionByName(deep.select(*columns))


def hash_key(seed: int | Column, *keys: Column) -> Column:
    """Seeded, engine-independent replacement of a pseudo-random shuffle key."""
    s = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", s, *[k.cast("string") for k in keys]))


def with_row_index(
    df: DataFrame, order: Sequence[str] | None = None, name: str = "row_idx", start: int = 0
) -> DataFrame:
    """Contiguous row index.

    With ``order`` the index follows that total order. Without it the index
    follows the scan order of the source files (partition id, then position in
    the partition), which is stable while the files do not change; the rows are
    written to the checkpoint folder for that.
    """
    if order:
        out = with_position(df, [], order, name)
        return out.withColumn(name, F.col(name) + F.lit(start)) if start else out
    # Numbers and offsets must come from the very same partitions, and a plan with a
    # shuffle may be cut anew for each use: the tagged rows are written once.
    # The id holds the partition above bit 33 and the place in it below; offsets
    # are one row per partition, which bounds the broadcast, and rows stay where they are.
    checkpoint_dir(df.sparkSession)
    tagged = df.withColumn("_row_id", F.monotonically_increasing_id()).checkpoint().withColumn("_row_part", F.shiftright("_row_id", 33))
    counts = tagged.groupBy("_row_part").agg(F.count(F.lit(1)).alias("_row_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_row_part", F.coalesce(F.sum("_row_n").over(before), F.lit(0)).alias("_row_off"))
    place = F.col("_row_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = tagged.join(F.broadcast(offsets), "_row_part")
    return placed.select(*[F.col(c) for c in df.columns], (F.col("_row_off") + place + F.lit(start)).cast("long").alias(name))


def entry_id(prefix: str | Column, index: Column, width: int = 6) -> Column:
    """``<prefix>_<zero padded index>``."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.format_string(f"%s_%0{width}d", p, index)

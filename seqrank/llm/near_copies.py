"""Near-duplicate documents by DartMinHash signatures.

The shingles of five words of a text, weighted by how often they occur, are
regions of a weight axis. Hashed darts land in the regions at a random time; of
the darts of each coordinate the earliest is kept. Two texts agree in a
coordinate with probability equal to their weighted Jaccard similarity (sum of
minima over sum of maxima). Signatures are joined by bands; candidates are
compared by signature and then exactly, and linked texts (0.8 or more) form
classes.

No pair list of a group is made: in each band bucket members meet one pivot, and
linked ones are contracted to components. Where a bucket still holds several
components, its members are dealt to cells of bounded size; a cell compares all
its pairs of different components and returns a spanning forest of the links, so no
link between different texts is lost to the grouping. Equal texts are one node
from the start.

A null text is empty; equal texts are one class, empty ones too. Texts of fewer than
five words are one shingle. Of a null id the class is that of its text. Rows and
repeated rows all get a class: the smallest id in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts_of, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
COORDINATES = BANDS * ROWS
# Signature agreement below this is no candidate: four and a half standard deviations under 0.8.
AGREE = SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
# Rows of a block when a bucket is compared as a whole.
CELL_ROWS = 512

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# Time cells: the first from 0, then each as long as all before.
_CELL_END = np.array([2.0**i for i in range(-9, 50)])
_CELL_START = np.append(0.0, _CELL_END[:-1])


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities as 32-bit thresholds."""
    n = int(mean + 12 * mean**0.5 + 12)
    k = np.arange(n)
    log = k * np.log(mean) - mean - np.append(0.0, np.cumsum(np.log(np.arange(1, n))))
    return np.minimum(np.cumsum(np.exp(log)), 1.0) * 2.0**32


_TABLES: dict[float, np.ndarray] = {}


class Hasher:
    """64-bit hashes of words, kept for words seen before."""

    def __init__(self, most: int = 1_000_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.most:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(self.seen.__getitem__, words), dtype=_U, count=len(words))


def shingles(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the five-word shingles of a text, and their counts."""
    h = hasher(text.split())
    if not len(h):
        return np.empty(0, _U), np.empty(0, np.int64)
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, _U)
    for i in range(min(WORDS, len(h))):
        out = _mix(out + h[i:i + n] + _GOLD)
    return np.unique(out, return_counts=True)


def signatures_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row per weighted set: the identity (32 bits) of the earliest dart of each coordinate.

    Weight regions are [0, 1), [1, 2), [2, 4), ...; the number of darts of a region in
    a time cell is a Poisson draw by hash, each dart has a hashed weight, and only
    darts below the weight of the element count. Cells are opened in order of time
    until every coordinate is filled; all sets are worked on together.
    """
    k = COORDINATES
    out, filled = np.zeros(len(sets) * k, np.uint32), np.zeros(len(sets) * k, bool)
    sizes = np.array([len(x) for x, _ in sets], np.int64)
    filled.reshape(-1, k)[sizes == 0] = True
    items = np.concatenate([x for x, _ in sets] or [np.empty(0, _U)])
    weights = np.concatenate([w for _, w in sets] or [np.empty(0)]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    cell = 0
    while len(items):
        length = _CELL_END[cell] - _CELL_START[cell]
        found = []
        level, low, high = 0, 0.0, 1.0
        x, w, who = items, weights, owner
        while len(x):
            mean = length * (high - low)
            if mean not in _TABLES:
                _TABLES[mean] = _poisson_table(mean)
            steps = _TABLES[mean]
            seed = _mix(x + _U((cell * 64 + level + 1) * int(_GOLD) % 2**64))
            hit = np.flatnonzero(seed >= _U(min(int(steps[0] * 2.0**32), 2**64 - 1)))
            n = np.searchsorted(steps, seed[hit] / 2.0**32, side="right")
            at = np.repeat(hit, n)
            order = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            one = _mix(seed[at] + (order.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))
            place = who[at] * k + ((one >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
            open_ = ~filled[place]
            at, one, place = at[open_], one[open_], place[open_]
            two = _mix(one + _GOLD)
            keep = low + (two >> _U(32)) / 2.0**32 * (high - low) < w[at]
            one, two, place = one[keep], two[keep], place[keep]
            time = _CELL_START[cell] + ((one & _U(0xFFFFFFFF)) + (two & _U(0xFFFFFFFF)) / 2.0**32) / 2.0**32 * length
            found.append((place, time, (_mix(one ^ two) >> _U(32)).astype(np.uint32)))
            level, low, high = level + 1, high, high * 2
            more = w > low
            x, w, who = x[more], w[more], who[more]
        place, time, name = (np.concatenate(a) for a in zip(*found))
        order = np.argsort(-time, kind="stable")
        out[place[order]] = name[order]
        filled[place] = True
        waiting = ~filled.reshape(-1, k).all(1)
        more = waiting[owner]
        items, weights, owner = items[more], weights[more], owner[more]
        cell += 1
    return out.reshape(-1, k)


def bands_of(sigs: np.ndarray) -> np.ndarray:
    """Band keys of each signature row."""
    h = np.repeat((np.arange(BANDS, dtype=_U) * _GOLD)[None, :], len(sigs), axis=0)
    for r in range(ROWS):
        h = _mix(h + sigs[:, r::ROWS].astype(_U) + _U(r))
    return h.view(np.int64)


def unit_set(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one: the n-th copy of an element has a name of its own
    (32 bits), so set similarity of the names is the weighted Jaccard similarity."""
    total = int(counts.sum())
    copy = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort((_mix(np.repeat(items, counts) + copy.astype(_U) * _GOLD) >> _U(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, node (128-bit hash of the text), text``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, node, sig, bands`` of every whole text."""
    def run(batches):
        hasher = Hasher()
        for part in chunks(batches, "text"):
            sets = [shingles(t, hasher) for t in texts_of(part)]
            rows = signatures_of(sets)
            sig = [s.tobytes() if len(x) else None for s, (x, _) in zip(rows, sets)]
            bands = [b if len(x) else [] for b, (x, _) in zip(bands_of(rows), sets)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "node": part.column(1), "sig": pa.array(sig, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return keyed(docs).mapInArrow(run, "doc_id long, node binary, sig binary, bands array<long>")


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges ``a, b`` (``b`` the smaller) are a forest of stars: no node is both an end and a centre, and each end has one centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, comp`` for all ends of ``a, b`` edges: the smallest node of the component.

    Large-star and small-star steps: every round links nodes to the smallest neighbour,
    rows stay linear in the edges, and the number of rounds is logarithmic.
    """
    def small(e: DataFrame, larger: bool) -> DataFrame:
        """Link the neighbours of each node to its smallest neighbour."""
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        joined = both.join(least, F.col("a") == F.col("_a"))
        if larger:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    while not _stars(e):
        e = written(small(written(small(e, True), f"{name}-large"), False), f"{name}-small")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in a share of at least ``AGREE``."""
    sig = nodes.select("node", "sig")
    rows = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= AGREE))

    return rows.mapInArrow(keep, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose exact similarity is at least ``SIMILARITY``."""
    rows = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")

    def keep(batches):
        for batch in batches:
            ok = [likeness(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) >= SIMILARITY for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(keep, "a binary, b binary")


def _unit_sets(docs: DataFrame, seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, units`` of the nodes in ``wanted``, from the row with the smallest id."""
    owner = seen.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc"))

    def run(batches):
        hasher = Hasher()
        for part in chunks(batches, "text"):
            got = [unit_set(*shingles(t, hasher)) for t in texts_of(part)]
            yield pa.RecordBatch.from_pydict({"node": part.column(0), "units": pa.array([x.tobytes() for x in got], pa.binary())})

    rows = keyed(docs).join(owner, "node").where(F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "text")
    return rows.mapInArrow(run, "node binary, units binary")


def _in_cells(members: DataFrame, fn, schema: str, carried: list[str]) -> DataFrame:
    """Run ``fn`` on each pair of blocks of a band's members (``band, node, comp, ...``).

    A bucket is dealt by hash to blocks of about ``CELL_ROWS`` rows; a cell holds two
    blocks (or one, for pairs inside it), so a bucket of any size is spread over many
    tasks and no task sees more than two blocks. ``fn`` gets the columns of a
    cell and the masks of its two sides.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    blocks = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("nb"))
    dealt = members.join(blocks, "band").withColumn("blk", F.pmod(F.xxhash64("node"), "nb").cast("int")).withColumn("x", F.explode(F.expr("sequence(0, nb - 1)")))
    celled = dealt.select("band", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"), "blk", "node", "comp", *carried)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = celled.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def cells(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.stack([t.column(c).to_numpy() for c in range(3)])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(cut, cut[1:]):
                yield t.slice(a, b - a)
            held = t.slice(cut[-1]).combine_chunks()
        if held is not None:
            yield held

    def run(batches):
        out = {f.name: [] for f in arrow}
        for t in cells(batches):
            if t.num_rows < 2:
                continue
            for row in fn(t):
                for name, v in zip(out, row):
                    out[name].append(v)
            if len(next(iter(out.values()))) > 5000:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                out = {f.name: [] for f in arrow}
        yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return placed.mapInArrow(run, schema)


def _near_pairs(t: pa.Table) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of a cell: of different components, agreeing in enough
    coordinates, and not already met in an earlier band; best first."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    blk = t.column("blk").to_numpy()
    node, comp = t.column("node").to_pylist(), t.column("comp").to_pylist()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    number = {c: n for n, c in enumerate(dict.fromkeys(comp))}
    group = np.array([number[c] for c in comp])
    left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
    keys = bands_of(sig)
    at = int(np.flatnonzero(keys[0] == t.column("band")[0].as_py())[0])
    found = []
    for a in left:
        b = right[(right > a) if i == j else slice(None)]
        b = b[group[b] != group[a]]
        if not len(b):
            continue
        agree = (sig[b] == sig[a]).mean(1)
        b, agree = b[agree >= AGREE], agree[agree >= AGREE]
        first = (keys[b] == keys[a]).argmax(1) == at
        found.append((np.full(first.sum(), a), b[first], agree[first]))
    if not found:
        return node, comp, *(np.empty(0, int),) * 2, np.empty(0)
    a, b, agree = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-agree, kind="stable")
    return node, comp, a[order], b[order], agree[order]


def _suspects(t: pa.Table):
    """Members of a cell that have a candidate partner."""
    node, _, a, b, _ = _near_pairs(t)
    band = t.column("band")[0].as_py()
    for k in np.unique(np.concatenate([a, b])):
        yield band, node[k]


def _links(t: pa.Table):
    """Verified links of a cell that join its components: a spanning forest, not all pairs."""
    node, comp, a, b, _ = _near_pairs(t)
    units = t.column("units").to_pylist()
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(comp[x]), find(comp[y])
        if p != q and likeness(np.frombuffer(units[x], np.uint32), np.frombuffer(units[y], np.uint32)) >= SIMILARITY:
            root[p] = q
            yield node[x], node[y]


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row."""
    return _classed(docs).select("doc_id", "class_id", "class_size")


def _classed(docs: DataFrame) -> DataFrame:
    """``doc_id, node, comp, class_id, class_size`` for every row; ``comp`` names the class also where no member has an id."""
    seen = written(signatures(docs), "signatures")
    nodes = written(seen.where("sig is not null").groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    ids = seen.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    member = nodes.select("node", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1").select("band", "pivot")
    buckets = written(member.join(shared, "band").select("band", "node", "pivot"), "buckets")

    # Members of a bucket meet its smallest node.
    pairs = buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    agreeing = written(_agreeing(pairs, nodes), "agreeing")
    ends = agreeing.select(F.col("a").alias("node")).unionByName(agreeing.select(F.col("b").alias("node"))).distinct()
    links = written(_verified(agreeing, _unit_sets(docs, seen, ends)), "pivot-links")
    known = written(components(links, "pivots"), "pivot-components")

    # Members of different components meet where a bucket still holds several.
    placed = buckets.join(known, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    sig = nodes.select("node", "sig")
    open_ = placed.join(mixed, "band").join(sig, "node").select("band", "node", "comp", "sig")
    suspects = written(_in_cells(open_, _suspects, "band long, node binary", ["sig"]).distinct(), "suspects")
    sets = _unit_sets(docs, seen, suspects.select("node").distinct())
    last = placed.join(suspects, ["band", "node"]).join(sig, "node").join(sets, "node").select("band", "node", "comp", "sig", "units")
    more = written(_in_cells(last, _links, "a binary, b binary", ["sig", "units"]), "cell-links")
    # What the pivots joined goes on as the stars it has become.
    stars = known.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    known = written(components(stars.unionByName(more), "all"), "components")

    whole = ids.join(known, "node", "left").select("node", "least", "n", F.coalesce("comp", "node").alias("comp"))
    groups = whole.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = whole.join(groups, "comp").select("node", "comp", "class_id", "class_size")
    return seen.select("doc_id", "node").join(named, "node").select("doc_id", "node", "comp", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (null ids last, then by the hash
    of the text); of rows that repeat this id and text one stays."""
    names = docs.columns
    rows = _classed(docs).groupBy("comp", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("comp").agg(F.min_by(F.struct("doc_id", "node", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("f"))
    chosen = written(first.select(F.col("f.doc_id").alias("_keep"), F.col("f.node").alias("_keep_node"), F.col("f.n").alias("_n")), "chosen")
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed_docs = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_node", F.unhex(F.md5(text)))

    def of(part: DataFrame) -> DataFrame:
        return keyed_docs.join(part, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_node") == F.col("_keep_node")), "left_semi")

    once, repeated = of(chosen.where("_n = 1")).select(*names), chosen.where("_n > 1")
    # Rows that repeat an id and its text are rare: they alone are grouped, which shuffles the texts once more.
    return once if repeated.isEmpty() else once.unionByName(of(repeated).dropDuplicates(["_id", "_node"]).select(*names))

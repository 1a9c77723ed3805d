"""Cluster and split queries (inventory F, G, A9, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import entry_id, with_position, with_row_index
from ..operators import clusters as C
from ..operators import splits as S
from .registry import query, rnd, rounded

# ---------------------------------------------------------------- row index

@query("row_index", "A9", """
SELECT l_orderkey, l_linenumber, l_partkey, row_idx, printf('entry_%06d', row_idx) AS entry_id FROM (
SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_idx FROM {lineitem})""")
def row_index(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    out = with_row_index(t("lineitem").select(*order), order)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "row_idx", entry_id("entry", F.col("row_idx")).alias("entry_id"))


@query("row_index_scan_order", "A9", "SELECT count(*) AS n, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS distinct_ids FROM (SELECT row_number() OVER () - 1 AS i FROM {orders})")
def row_index_scan_order(t):
    out = with_row_index(t("orders").select("o_orderkey"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"), F.countDistinct("row_idx").alias("distinct_ids"))


# Scan order of what comes out of a shuffle: wide rows of an aggregate, a join, a distinct and a union.
_SHUFFLED = {
    "aggregate": "SELECT l_orderkey AS k, max(l_returnflag) AS a, repeat(md5(cast(l_orderkey as string)), 8) AS b FROM {lineitem} GROUP BY l_orderkey",
    "join": "SELECT l_orderkey AS k, l_linenumber AS a, repeat(coalesce(o_orderpriority, '-'), 16) AS b FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey",
    "distinct": "SELECT DISTINCT l_partkey AS k, l_shipdate AS a, repeat(md5(cast(l_partkey as string)), 8) AS b FROM {lineitem}",
    "union": "SELECT o_orderkey AS k, o_orderpriority AS a, md5(cast(o_orderkey as string)) AS b FROM {orders} UNION ALL SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM {lineitem}",
}


@query("row_index_shuffled", "A9", " UNION ALL ".join(
    f"SELECT '{name}' AS input, count(*) AS n, 0 AS lo, count(*) - 1 AS hi, count(*) AS distinct_ids FROM ({sql})" for name, sql in _SHUFFLED.items()))
def row_index_shuffled(t):
    out = None
    for name, sql in _SHUFFLED.items():
        numbered = with_row_index(t.sql(sql))
        part = numbered.agg(F.lit(name).alias("input"), F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"),
                            F.countDistinct("row_idx").alias("distinct_ids"))
        out = part if out is None else out.unionByName(part)
    return out


# The way of large groups, forced: text keys with a common beginning, and one group with five hot values.
@query("position_leveled_names", "A9", """
SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) - 1 AS position, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM {customer}""")
def position_leveled_names(t):
    rows = t("customer").select("c_custkey", "c_mktsegment", "c_name")
    return with_position(rows, ["c_mktsegment"], ["c_name", "c_custkey"], total="n", window_rows=0).select("c_custkey", "position", "n")


@query("position_leveled_hot", "A9", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) - 1 AS position FROM {orders}")
def position_leveled_hot(t):
    rows = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return with_position(rows, [], ["o_orderpriority", "o_totalprice", "o_orderkey"], window_rows=0).select("o_orderkey", "position")


# ---------------------------------------------------------------- clusters

@query("exact_sequence_groups", "F2", "SELECT sha256(text) AS seq_hash, min(doc_id) AS representative, count(*) AS size FROM {documents} GROUP BY text")
def exact_sequence_groups(t):
    return C.exact_sequence_groups(t("documents"), "text", "doc_id")


def _variants(t):
    """Mutated heavy chains: families of near copies around each wild type."""
    from ..functions.mutation_text import apply_mutations_checked

    rows = t("heavy_mut").select("rid", apply_mutations_checked("seq", "mutant").alias("seq"))
    return with_row_index(rows, ["rid"])


# Variants of a wild type differ at four of 32 places at most, and wild types are unrelated, so any right
# clustering at 0.8 finds the families; malformed mutations leave the wild type.
@query("cluster_sequences", "F1", """
SELECT min(row_idx) AS representative, count(*) AS size
FROM (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS row_idx FROM {heavy_mut})
GROUP BY poi""")
def cluster_sequences(t):
    """Cluster sizes."""
    out = C.cluster_sequences(_variants(t), "seq", min_identity=0.8, coverage=0.8)
    return out.groupBy("representative").agg(F.count(F.lit(1)).alias("size"))


@query("cluster_sequences_remote", "F1")
def cluster_sequences_remote(t):
    """Cluster sizes at identity 0.3, as for antigens."""
    out = C.cluster_sequences(_variants(t), "seq", min_identity=0.3, coverage=0.8)
    return out.groupBy("representative").agg(F.count(F.lit(1)).alias("size"))


_MAP = "SELECT text AS t, cast(doc_id AS string) AS member, cast(min(doc_id) OVER (PARTITION BY text) AS string) AS representative, doc_id AS row_idx FROM {documents}"


@query("attach_clusters", "F3", """
SELECT d.doc_id, coalesce(m.representative, 'unknown') AS cluster FROM {documents} d
LEFT JOIN (SELECT * FROM m WHERE length(t) > 300) m ON m.row_idx = d.doc_id""", {"m": _MAP})
def attach_clusters(t):
    mapping = t.sql(_MAP).filter("length(t) > 300")
    docs = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("entry"))
    return C.attach_clusters(docs, mapping, "entry", "cluster", "unknown").select("doc_id", "cluster")


@query("label_clusters", "F4", """
SELECT member, printf('ab_%04d', dense_rank() OVER (ORDER BY f)) AS label
FROM (SELECT member, min(row_idx) OVER (PARTITION BY representative) AS f FROM m)""", {"m": _MAP})
def label_clusters(t):
    return C.label_clusters(t.sql(_MAP), "ab")


@query("cluster_by_name", "F5", """
SELECT doc_id, coalesce(printf('ag_%03d', r), 'ag_unknown') AS ag_cluster_id FROM (
SELECT doc_id, CASE WHEN n IS NOT NULL THEN dense_rank() OVER (PARTITION BY n IS NULL ORDER BY n) - 1 END AS r FROM (SELECT doc_id, CASE WHEN lang <> 'en' THEN source END AS n FROM {documents}))""")
def cluster_by_name(t):
    docs = t("documents").select("doc_id", F.when(F.col("lang") != "en", F.col("source")).alias("n"))
    return C.cluster_by_name(docs, "n", fill="ag_unknown").select("doc_id", "ag_cluster_id")


@query("cluster_by_columns", "F5 B11", """
SELECT p_partkey, 'lev3_' || p_size AS ab_cluster_id, 'ag_' || regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS ag_cluster_id,
       'lev3_' || p_size || '__ag_' || regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS ab_ag_cluster FROM {part}""")
def cluster_by_columns(t):
    return C.cluster_by_columns(t("part"), "p_size", "p_name").select("p_partkey", "ab_cluster_id", "ag_cluster_id", "ab_ag_cluster")


_PAIRS = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('x', cast(o_custkey % 9 AS string), '_', cast(o_custkey AS string)) END AS ab,
 CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN concat('x', cast(o_custkey % 9 AS string), '_', cast(o_custkey AS string)) ELSE concat('y', cast(o_custkey % 4 AS string), '_1') END AS ag FROM {orders}"""


@query("combine_clusters", "F6", f"""
SELECT o_orderkey, ab || '__' || ag AS double_style, CASE WHEN ab = '' OR ag = '' THEN '' ELSE ab || '_' || ag END AS single_style,
       CASE WHEN ab = '' OR ag = '' THEN '' WHEN ab = ag THEN split_part(ab, '_', 1) ELSE split_part(ab, '_', 1) || '_' || split_part(ag, '_', 1) END AS prefix_style
FROM ({_PAIRS})""")
def combine_clusters(t):
    ab, ag = F.col("ab"), F.col("ag")
    return t.sql(_PAIRS).select("o_orderkey", *[C.combine_clusters(ab, ag, s).alias(f"{s}_style") for s in ("double", "single", "prefix")])


@query("group_ids", "F7", "SELECT row_idx, coalesce(cluster, 'unknown') AS group_id, 'ab_ag_cluster' AS group_key FROM {clustered}")
def group_ids(t):
    out = C.group_ids(t("clustered").withColumnRenamed("cluster", "ab_ag_cluster").withColumn("Ag_name", F.col("status")))
    return out.select("row_idx", "group_id", "group_key")


@query("group_ids_fallback", "F7", "SELECT doc_id, source || '|' || lang AS group_id, 'Ab_name+Ag_name' AS group_key FROM {documents}")
def group_ids_fallback(t):
    docs = t("documents").select("doc_id", F.col("source").alias("Ab_name"), F.col("lang").alias("Ag_name"), F.when(F.col("doc_id") % 3 == 0, "c").alias("ab_ag_cluster"))
    return C.group_ids(docs).select("doc_id", "group_id", "group_key")


@query("trainer_group_ids", "F7", "SELECT doc_id, substr(text, 1, 24) AS group_id FROM {documents}")
def trainer_group_ids(t):
    return C.trainer_group_ids(t("documents").select("doc_id", F.col("text").alias("Antigen"))).select("doc_id", "group_id")


@query("cluster_stats", "F8", f"""
SELECT count(*) AS rows, {rnd('min(affinity)', 'label_min')}, {rnd('max(affinity)', 'label_max')}, {rnd('avg(affinity)', 'label_mean', 4)}, {rnd('stddev_pop(affinity)', 'label_std', 4)},
       count(DISTINCT cluster) AS ab_clusters, count(DISTINCT status) AS ag_clusters, count(DISTINCT cluster || status) AS pair_clusters FROM {{clustered}}""")
def cluster_stats(t):
    rows = t("clustered").withColumn("pair", F.concat("cluster", "status"))
    return rounded(rounded(C.cluster_stats(rows, "affinity", "cluster", "status", "pair")).withColumns(
        {c: F.round(c, 4) + 0.0 for c in ("label_mean", "label_std")}))


# ---------------------------------------------------------------- greedy splits

def _rows(missing: str) -> str:
    value = {"group": "coalesce(cluster, '__missing_cluster__')", "drop": "cluster", "row": "coalesce(cluster, printf('cluster_%04d', row_idx))"}[missing]
    return f"SELECT row_idx, {value} AS cluster FROM {{clustered}}" + (" WHERE cluster IS NOT NULL" if missing == "drop" else "")


def _lightest(k: int, count_ties: bool = False) -> str:
    """Bin of the lightest load, lower number first (or fewer groups, then lower number)."""
    if not count_ties:
        low = f"least({', '.join(f'l{j}' for j in range(k))})"
        return "CASE " + " ".join(f"WHEN l{j} = {low} THEN {j}" for j in range(k)) + " END"
    low = f"least({', '.join(f'l{j} * 1000000 + g{j}' for j in range(k))})"
    return "CASE " + " ".join(f"WHEN l{j} * 1000000 + g{j} = {low} THEN {j}" for j in range(k)) + " END"


def _greedy(k: int, seed: int, missing: str = "group", count_ties: bool = False) -> dict[str, str]:
    """Item-by-item greedy assignment as a recursive query."""
    bins = range(k)
    state = [f"l{j}" for j in bins] + ([f"g{j}" for j in bins] if count_ties else [])
    upd = [f"l{j} + CASE WHEN b = {j} THEN size ELSE 0 END AS l{j}" for j in bins]
    if count_ties:
        upd += [f"g{j} + CASE WHEN b = {j} THEN 1 ELSE 0 END AS g{j}" for j in bins]
    return {
        "src": _rows(missing),
        "sz": "SELECT cluster, count(*) AS size FROM src GROUP BY cluster",
        "ord": f"SELECT *, row_number() OVER (ORDER BY size DESC, md5('{seed}|' || cluster)) AS i FROM sz",
        "rec": f"""SELECT 0::bigint AS i, '' AS cluster, 0::bigint AS size, -1 AS test_fold, {', '.join(f'0::bigint AS {s}' for s in state)}
                   UNION ALL SELECT i, cluster, size, b AS test_fold, {', '.join(upd)} FROM (
                   SELECT o.i, o.cluster, o.size, {_lightest(k, count_ties)} AS b, {', '.join(f'r.{s}' for s in state)} FROM rec r JOIN ord o ON o.i = r.i + 1)""",
        "tested": "SELECT cluster, size, test_fold FROM rec WHERE i > 0",
    }


def _valid_loop(k: int, seed: int, frac: float) -> dict[str, str]:
    """First-fit validation choice as a recursive query, then the extra cluster and the guards."""
    return {
        "pool": f"""SELECT f AS fold, cluster, size, row_number() OVER (PARTITION BY f ORDER BY size DESC, md5((f + {seed + 1000}) || '|' || cluster)) AS i
                    FROM tested, range({k}) r(f) WHERE test_fold <> f""",
        "tgt": f"SELECT fold, cast(round_even(sum(size) * {frac}, 0) AS bigint) AS target, max(i) AS m FROM pool GROUP BY fold",
        "fit": """SELECT fold, 0::bigint AS i, '' AS cluster, 0::bigint AS size, 0::bigint AS total, false AS took FROM tgt
                  UNION ALL SELECT f.fold, p.i, p.cluster, p.size, f.total + CASE WHEN f.total + p.size <= target THEN p.size ELSE 0 END, f.total + p.size <= target
                  FROM fit f JOIN pool p ON p.fold = f.fold AND p.i = f.i + 1 JOIN tgt t ON t.fold = f.fold""",
        "fin": "SELECT fold, max(total) AS total, sum(CASE WHEN took THEN 1 ELSE 0 END) AS n FROM fit GROUP BY fold",
        "extra": """SELECT fold, arg_min(i, (abs(n.total + size - target), i)) AS i FROM fit JOIN (SELECT fold, total FROM fin) n USING (fold) JOIN tgt USING (fold)
                    WHERE fit.i > 0 AND NOT took AND n.total < target GROUP BY fold""",
        "val": """SELECT f.fold, f.cluster, (took OR f.i IS NOT DISTINCT FROM e.i OR (n.n = 0 AND e.i IS NULL AND f.i = 1))
                  AND NOT (n.n + CASE WHEN e.i IS NULL THEN 0 ELSE 1 END = m AND m > 1 AND f.i = m) AS v
                  FROM fit f JOIN tgt USING (fold) JOIN fin n USING (fold) LEFT JOIN extra e USING (fold) WHERE f.i > 0""",
        "dec": """SELECT fold, cluster, CASE WHEN v THEN 'valid' ELSE 'train' END AS split FROM val UNION ALL SELECT test_fold, cluster, 'test' FROM tested""",
    }


_BY_CLUSTER = "SELECT cast(d.fold AS int) AS fold, split, row_idx FROM src JOIN dec d USING (cluster)"


@query("greedy_balanced_kfold", "G1 G2", _BY_CLUSTER, {**_greedy(5, 42), **_valid_loop(5, 42, 0.1)})
def greedy_balanced_kfold(t):
    return S.greedy_balanced_kfold(t("clustered"), "cluster", 5, 0.1, 42)


@query("kfold_random_valid", "G3", _BY_CLUSTER, {**_greedy(5, 7, "drop"),
    "pool": "SELECT f AS fold, cluster, row_number() OVER (PARTITION BY f ORDER BY md5((f + 7) || '|' || cluster)) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM tested, range(5) r(f) WHERE test_fold <> f",
    "dec": "SELECT fold, cluster, CASE WHEN i < floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split FROM pool UNION ALL SELECT test_fold, cluster, 'test' FROM tested"})
def kfold_random_valid(t):
    return S.kfold_random_valid(t("clustered"), "cluster", 5, 0.1, 7)


@query("single_split_deficit", "G4", "SELECT 0 AS fold, s AS split, row_idx FROM src JOIN rec USING (cluster)", {
    "src": _rows("drop"),
    "sz": "SELECT cluster, count(*) AS size FROM src GROUP BY cluster",
    "ord": "SELECT *, row_number() OVER (ORDER BY size DESC, md5('3|' || cluster)) AS i FROM sz",
    "tg": "SELECT n - floor(n * 0.2) - floor(n * 0.1) AS t0, floor(n * 0.1) AS t1, floor(n * 0.2) AS t2 FROM (SELECT count(*) AS n FROM {clustered})",
    "rec": """SELECT 0::bigint AS i, '' AS cluster, '' AS s, 0::bigint AS n0, 0::bigint AS n1, 0::bigint AS n2
              UNION ALL SELECT i, cluster, s, n0 + CASE WHEN s = 'train' THEN size ELSE 0 END, n1 + CASE WHEN s = 'valid' THEN size ELSE 0 END, n2 + CASE WHEN s = 'test' THEN size ELSE 0 END
              FROM (SELECT o.i, o.cluster, o.size, n0, n1, n2, CASE WHEN greatest(t0 - n0, t1 - n1, t2 - n2) > 0
                THEN CASE greatest(t0 - n0, t1 - n1, t2 - n2) WHEN t0 - n0 THEN 'train' WHEN t1 - n1 THEN 'valid' ELSE 'test' END
                ELSE CASE least(n0, n1, n2) WHEN n0 THEN 'train' WHEN n1 THEN 'valid' ELSE 'test' END END AS s FROM rec r JOIN ord o ON o.i = r.i + 1, tg)"""})
def single_split_deficit(t):
    return S.single_split_deficit(t("clustered"), "cluster", 0.2, 0.1, 3)


@query("group_kfold", "G7", _BY_CLUSTER, {**{k: v for k, v in _greedy(3, 11).items()},
    "pool": "SELECT f AS fold, cluster, size, row_number() OVER (PARTITION BY f ORDER BY size DESC, md5((f + 11) || '|' || cluster)) AS i FROM tested, range(3) r(f) WHERE test_fold <> f",
    "run": "SELECT *, coalesce(sum(size) OVER (PARTITION BY fold ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT greatest(1, round_even(count(*) * 0.1, 0)) FROM src) AS target FROM pool",
    "dec": "SELECT fold, cluster, CASE WHEN before < target THEN 'valid' ELSE 'train' END AS split FROM run UNION ALL SELECT test_fold, cluster, 'test' FROM tested",
    "src": "SELECT row_idx, coalesce(cluster, 'unknown') AS cluster FROM {clustered}"})
def group_kfold(t):
    return S.group_kfold(t("clustered"), "cluster", 3, 0.1, 11)


@query("balanced_group_folds", "G10", "SELECT test_fold AS fold, row_idx FROM src JOIN tested USING (cluster)", _greedy(4, 5, count_ties=True))
def balanced_group_folds(t):
    return S.balanced_group_folds(t("clustered"), "cluster", 4, 5)


_G11 = {**_greedy(9, 5, count_ties=True),
        "sums": "SELECT test_fold, sum(size) AS s FROM tested GROUP BY test_fold",
        "pick": "SELECT arg_min(test_fold, (abs(s - (SELECT round_even(count(*) * 0.1, 0) FROM src)), s, test_fold)) AS f FROM sums"}


@query("group_train_valid", "G11", "SELECT 0 AS fold, CASE WHEN test_fold = (SELECT f FROM pick) THEN 'valid' ELSE 'train' END AS split, row_idx FROM src JOIN tested USING (cluster)", _G11)
def group_train_valid(t):
    return S.group_train_valid(t("clustered"), "cluster", 0.1, 5)


def _inner_greedy(k: int, bins: int, seed: int, frac: float) -> dict[str, str]:
    """The rest of each fold dealt to ``bins`` group folds; the one closest to the target is validation."""
    state = [f"{x}{j}" for x in "lg" for j in range(bins)]
    upd = [f"l{j} + CASE WHEN b = {j} THEN size ELSE 0 END AS l{j}" for j in range(bins)] + [f"g{j} + CASE WHEN b = {j} THEN 1 ELSE 0 END AS g{j}" for j in range(bins)]
    return {
        "pool": f"""SELECT f AS fold, cluster, size, row_number() OVER (PARTITION BY f ORDER BY size DESC, md5((f + {seed + 1}) || '|' || cluster)) AS i
                    FROM tested, range({k}) r(f) WHERE test_fold <> f""",
        "inr": f"""SELECT f AS fold, 0::bigint AS i, '' AS cluster, 0::bigint AS size, -1 AS bin, {', '.join(f'0::bigint AS {s}' for s in state)} FROM range({k}) r(f)
                   UNION ALL SELECT fold, i, cluster, size, b AS bin, {', '.join(upd)} FROM (
                   SELECT p.fold, p.i, p.cluster, p.size, {_lightest(bins, True)} AS b, {', '.join(f'r.{s}' for s in state)} FROM inr r JOIN pool p ON p.fold = r.fold AND p.i = r.i + 1)""",
        "tgt": f"SELECT fold, greatest(1, round_even(sum(size) * {frac}, 0)) AS target FROM pool GROUP BY fold",
        "sums": "SELECT fold, bin, sum(size) AS s FROM inr WHERE i > 0 GROUP BY fold, bin",
        "pick": "SELECT fold, arg_min(bin, (abs(s - target), s, bin)) AS f FROM sums JOIN tgt USING (fold) GROUP BY fold",
        "dec": """SELECT fold, cluster, CASE WHEN bin = f THEN 'valid' ELSE 'train' END AS split FROM inr JOIN pick USING (fold) WHERE i > 0
                  UNION ALL SELECT test_fold, cluster, 'test' FROM tested""",
    }


@query("default_cv_group", "G12 G10 G11", _BY_CLUSTER, {**_greedy(4, 5, count_ties=True), **_inner_greedy(4, 9, 5, 0.1)})
def default_cv_group(t):
    return S.default_cv(t("clustered"), 4, "cluster", 5)


# ---------------------------------------------------------------- hash-order splits

def _inner(pool: str) -> str:
    return f"SELECT fold, row_idx, row_number() OVER (PARTITION BY fold ORDER BY md5('inner' || fold || '|' || row_idx)) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM {pool}"


@query("default_cv_random", "G12", """
SELECT fold, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split, row_idx FROM inn
UNION ALL SELECT home, 'test', row_idx FROM base""", {
    "base": """SELECT row_idx, cast(CASE WHEN p < (n % 4) * (n // 4 + 1) THEN p // (n // 4 + 1) ELSE n % 4 + (p - (n % 4) * (n // 4 + 1)) // (n // 4) END AS int) AS home
               FROM (SELECT row_idx, row_number() OVER (ORDER BY md5('9|' || row_idx)) - 1 AS p, count(*) OVER () AS n FROM {clustered})""",
    "ev": "SELECT cast(f AS int) AS fold, row_idx FROM base, range(4) r(f) WHERE home <> f",
    "inn": _inner("ev")})
def default_cv_random(t):
    return S.default_cv(t("clustered"), 4, None, 9)


@query("default_cv_single", "G12", """
SELECT 0 AS fold, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split, row_idx FROM inn
UNION ALL SELECT 0, 'test', row_idx FROM base WHERE p >= floor(n * 0.8)""", {
    "base": "SELECT row_idx, row_number() OVER (ORDER BY md5('9|' || row_idx)) - 1 AS p, count(*) OVER () AS n FROM {clustered}",
    "ev": "SELECT 0 AS fold, row_idx FROM base WHERE p < floor(n * 0.8)",
    "inn": _inner("ev")})
def default_cv_single(t):
    return S.default_cv(t("clustered"), 1, None, 9)


@query("repeated_random_folds", "G5", """
SELECT fold, CASE WHEN i < round_even(n * 0.2, 0) THEN 'test' WHEN i < round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'valid' ELSE 'train' END AS split, row_idx
FROM (SELECT cast(f AS int) AS fold, row_idx, row_number() OVER (PARTITION BY f ORDER BY md5((f + 42) || '|' || row_idx)) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM {clustered}, range(5) r(f))""")
def repeated_random_folds(t):
    return S.repeated_random_folds(t("clustered"), 5, 0.1, 0.2, 42)


_SLICED = {
    "base": """SELECT row_idx, n, cast(least(p // cast(floor(n * 0.2) AS bigint), 4) AS int) AS home
               FROM (SELECT row_idx, row_number() OVER (ORDER BY md5('42|' || row_idx)) - 1 AS p, count(*) OVER () AS n FROM {clustered})""",
    "rest": "SELECT cast(f AS int) AS fold, row_idx, n, row_number() OVER (PARTITION BY f ORDER BY md5('rest' || (f + 42) || '|' || row_idx)) - 1 AS i FROM base, range(5) r(f) WHERE home <> f",
    "sl": "SELECT fold, CASE WHEN i < floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split, row_idx FROM rest UNION ALL SELECT home, 'test', row_idx FROM base"}


@query("sliced_random_folds", "G6", "SELECT fold, split, row_idx FROM sl", _SLICED)
def sliced_random_folds(t):
    return S.sliced_random_folds(t("clustered"), 5, 42)


@query("sliced_fold_clusters", "G6", "SELECT DISTINCT fold, split, coalesce(cluster, 'unknown') AS cluster FROM sl JOIN {clustered} USING (row_idx)", _SLICED)
def sliced_fold_clusters(t):
    return S.fold_clusters(S.sliced_random_folds(t("clustered"), 5, 42), t("clustered"), "cluster")


_ROW_VALID = """SELECT fold, row_idx, row_number() OVER (PARTITION BY fold ORDER BY md5('valid' || (fold + 42) || '|' || row_idx)) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM ev"""
_ROW_SPLIT = "CASE WHEN i < least(greatest(1, round_even(n * 0.1, 0)), n - 1) THEN 'valid' ELSE 'train' END AS split"


@query("cluster_slice_folds", "G8", f"SELECT fold, {_ROW_SPLIT}, row_idx FROM rv UNION ALL SELECT home, 'test', row_idx FROM src JOIN homes USING (cluster)", {
    "src": _rows("row"),
    "homes": """SELECT cluster, cast(((p + 1) * 5 - 1) // n AS int) AS home FROM (SELECT cluster, row_number() OVER (ORDER BY md5('42|' || cluster)) - 1 AS p, count(*) OVER () AS n
                FROM (SELECT DISTINCT cluster FROM src))""",
    "ev": "SELECT cast(f AS int) AS fold, row_idx FROM src JOIN homes USING (cluster), range(5) r(f) WHERE home <> f",
    "rv": _ROW_VALID})
def cluster_slice_folds(t):
    return S.cluster_slice_folds(t("clustered"), "cluster", 5, 0.1, 42)


@query("cluster_single_split", "G9", f"SELECT fold, {_ROW_SPLIT}, row_idx FROM rv UNION ALL SELECT 0, 'test', row_idx FROM src JOIN homes USING (cluster) WHERE tst", {
    "src": _rows("row"),
    "homes": """SELECT cluster, p < least(greatest(1, round_even(n * 0.2, 0)), n - 1) AS tst FROM (SELECT cluster, row_number() OVER (ORDER BY md5('42|' || cluster)) - 1 AS p, count(*) OVER () AS n
                FROM (SELECT DISTINCT cluster FROM src))""",
    "ev": "SELECT 0 AS fold, row_idx FROM src JOIN homes USING (cluster) WHERE NOT tst",
    "rv": _ROW_VALID})
def cluster_single_split(t):
    return S.cluster_single_split(t("clustered"), "cluster", 0.1, 0.2, 42)


@query("train_valid_random", "G13", """
SELECT CASE WHEN p < least(greatest(1, round_even(n * 0.15, 0)), n - 1) THEN 'valid' ELSE 'train' END AS split, row_idx
FROM (SELECT row_idx, row_number() OVER (ORDER BY md5('1|' || row_idx)) - 1 AS p, count(*) OVER () AS n FROM {clustered})""")
def train_valid_random(t):
    return S.train_valid_random(t("clustered"), 0.15, 1)


@query("stratified_sample", "G14", """
SELECT rid, stratum, price FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || rid)) AS rn FROM {strata}) JOIN al USING (stratum) WHERE rn <= take""", {
    "ct": "SELECT stratum, count(*) AS n, count(*) * 1234.0::double / (SELECT count(*) FROM {strata}) AS e FROM {strata} GROUP BY stratum",
    "al": "SELECT stratum, floor(e) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, stratum) <= 1234 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS take FROM ct"})
def stratified_sample(t):
    return S.stratified_sample(t("strata"), "stratum", 1234, "rid", 42)


@query("qcut_bins", "G15", """
SELECT row_idx, CASE WHEN v IS NOT NULL THEN cast(greatest((SELECT count(*) FROM e WHERE e.q < a.v), 1) - 1 AS int) END AS bin
FROM (SELECT row_idx, try_cast(kd_text AS double) AS v FROM {affinity}) a""", {
    "e": "SELECT DISTINCT unnest(quantile_cont(try_cast(kd_text AS double), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q FROM {affinity}"})
def qcut_bins(t):
    rows = t("affinity").select("row_idx", F.col("kd_text").try_cast("double").alias("v"))
    return S.qcut_bins(rows, "v", 5).select("row_idx", "bin")


@query("rank_and_width_bins", "G15", """
SELECT row_idx, cast(least(rn // cast(ceil(n / 6.0) AS bigint), 5) AS int) AS rank_bin,
       cast(least(greatest(ceil((v - lo) / ((hi - lo) / 6)) - 1, 0), 5) AS int) AS width_bin
FROM (SELECT row_idx, affinity AS v, row_number() OVER (ORDER BY affinity, row_idx) - 1 AS rn, count(*) OVER () AS n, min(affinity) OVER () AS lo, max(affinity) OVER () AS hi FROM {clustered})""")
def rank_and_width_bins(t):
    rows = t("clustered").select("row_idx", "affinity")
    out = S.width_bins(S.rank_bins(rows, "affinity", "row_idx", 6, "rank_bin"), "affinity", 6, "width_bin")
    return out.select("row_idx", "rank_bin", "width_bin")


# ---------------------------------------------------------------- checks

def _simple_folds(t):
    """A split that leaks on purpose: folds by row, clusters across splits."""
    return t.sql(_SIMPLE)


_SIMPLE = """SELECT cast(f AS int) AS fold, CASE WHEN (o_orderkey + f) % 10 < 7 THEN 'train' WHEN (o_orderkey + f) % 10 < 8 THEN 'valid' ELSE 'test' END AS split, o_orderkey AS row_idx
FROM {orders} CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2) r"""
_OVERLAP = "SELECT fold, what, value, bool_or(split = 'train') AS a, bool_or(split = 'valid') AS b, bool_or(split = 'test') AS c FROM x WHERE value IS NOT NULL GROUP BY fold, what, value"


@query("check_leakage", "G16", """
SELECT fold, what, count(*) FILTER (a AND b) AS train_valid, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS valid_test FROM o GROUP BY fold, what""", {
    "sp": _SIMPLE,
    "x": "SELECT fold, split, 'row_idx' AS what, cast(row_idx AS varchar) AS value FROM sp UNION ALL SELECT fold, split, 'cluster', cluster FROM sp JOIN {clustered} USING (row_idx)",
    "o": _OVERLAP})
def check_leakage(t):
    return S.check_leakage(_simple_folds(t), t("clustered"), ["cluster"])


@query("split_summary", "G17", f"""
SELECT fold, split, cast(sum(n) AS bigint) AS rows, count(cluster) AS clusters, coalesce(max(CASE WHEN cluster IS NOT NULL THEN n END), 0) AS largest_cluster,
       round(coalesce(max(CASE WHEN cluster IS NOT NULL THEN n END), 0) * 100.0::double / sum(n), 6) + 0.0 AS largest_pct,
       round(sum(n) * 100.0::double / sum(sum(n)) OVER (PARTITION BY fold), 6) + 0.0 AS rows_pct
FROM (SELECT fold, split, cluster, count(*) AS n FROM sp JOIN {{clustered}} USING (row_idx) GROUP BY ALL) GROUP BY fold, split""", {"sp": _SIMPLE})
def split_summary(t):
    return rounded(S.split_summary(_simple_folds(t), t("clustered"), "cluster"))


_PRINT = """SELECT count(*) AS size, cast(sum(cast(('0x' || substr(md5(row_idx || chr(31) || coalesce(cluster, '<NA>') || chr(31) || status), 1, 15)) AS hugeint)) AS varchar) AS fingerprint FROM {clustered}"""


@query("fingerprint", "G18", _PRINT)
def fingerprint(t):
    return S.fingerprint(t("clustered"), ["cluster", "status"])


@query("validate_splits", "G19", "SELECT size, size AS said_size, 3::bigint AS folds, true AS size_ok, true AS fingerprint_ok, true AS folds_ok, true AS ok FROM f", {"f": _PRINT})
def validate_splits(t):
    meta = S.fingerprint(t("clustered"), ["cluster", "status"])
    return S.require_valid(S.validate_splits(t("clustered"), _simple_folds(t), meta, ["cluster", "status"]))


@query("materialize_fold", "G20", f"SELECT row_idx, cluster, {rnd('affinity', 'affinity')}, split FROM {{clustered}} JOIN sp USING (row_idx) WHERE fold = 1", {"sp": _SIMPLE})
def materialize_fold(t):
    return rounded(S.materialize_fold(t("clustered"), _simple_folds(t), 1).select("row_idx", "cluster", "affinity", "split"))


@query("fold_entry_ids", "G21", "SELECT fold, split, row_idx, 'e' || row_idx AS entry_id FROM sp", {"sp": _SIMPLE})
def fold_entry_ids(t):
    named = t("clustered").select("row_idx", F.concat(F.lit("e"), F.col("row_idx").cast("string")).alias("eid"))
    return S.fold_entry_ids(named, _simple_folds(t), "eid")



"""Query registry and the fixtures that derive domain tables from the base tables.

A fixture is one SELECT text that both Spark and DuckDB understand; ``{name}``
refers to a base table or another fixture, and ``@HEX(expr)@`` reads
hexadecimal text as a number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Query:
    name: str
    items: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
FIXTURES: dict[str, str] = {}
_PLACEHOLDER = re.compile(r"\{(\w+)\}")
_HEX = re.compile(r"@HEX\((.*?)\)@")


class Tables:
    """Base tables and fixtures of one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        if name in ("logits", "chain_logits"):
            return self.model_outputs(name)
        text = _HEX.sub(r"cast(conv(\1, 16, 10) as bigint)", FIXTURES[name])
        return self.sql(text)

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """``text`` over fixtures and base tables, or over ``given`` frames of their names."""
        parts = {n: given[n] if n in given else self(n) for n in set(_PLACEHOLDER.findall(text))}
        return self.spark.sql(text, **parts)

    def spread(self, name: str, factor: int) -> DataFrame:
        """A fixture over base tables whose rows are dealt out first; each stands for the work of ``factor`` rows."""
        text = FIXTURES[name]
        return self.spark.sql(text, **{n: spread(self(n), factor) for n in set(_PLACEHOLDER.findall(text))})

    def model_outputs(self, name: str, key: str | None = None, whole: bool = False) -> DataFrame:
        """The rows of the fixture ``logits`` or ``chain_logits``, laid out by position as a table of model outputs would be.

        Positions are dealt out before they become residues, so what groups or joins residues by their
        position finds them together; ``whole`` sequences are kept together instead, for what groups residues by
        their sequence too. ``key`` adds a column ``poi/chain`` by that name, which then stands for both.
        """
        rows = spread(self("part").selectExpr("p_partkey", "concat('p', cast(p_partkey as string)) AS poi"), OUTPUTS_PER_PART)
        keys, logit, factor = ["poi"], "p_partkey * 31 + pos * 17 + ascii(aa) * 13", OUTPUTS_PER_PART
        if name == "chain_logits":
            rows = rows.crossJoin(F.broadcast(self.spark.sql("SELECT 'H' AS chain UNION ALL SELECT 'L' UNION ALL SELECT 'A'")))
            keys, logit, factor = ["poi", "chain"], f"{logit} + ascii(chain) * 7", 3 * OUTPUTS_PER_PART
        if key:
            rows, keys = rows.withColumn(key, F.concat("poi", F.lit("/"), "chain")), [key]
        tasks, positions = task_count(self("part"), factor), F.broadcast(self("positions"))
        rows = rows.repartition(tasks, *keys).crossJoin(positions) if whole else rows.crossJoin(positions).repartition(tasks, *keys, "pos")
        rows = rows.crossJoin(F.broadcast(self("residues"))).withColumn("logit", F.expr(f"(({logit}) % 997) / 100E0"))
        return rows.select("poi", *(["chain"] if name == "chain_logits" else []), "pos", "aa", "logit", *([key] if key else []))


# Rows that one task builds, and residues of all positions of a chain in the model outputs.
TASK_ROWS, OUTPUTS_PER_PART = 1_000_000, 640


def task_count(df: DataFrame, factor: int) -> int:
    """Tasks for ``df`` when each of its rows stands for the work of ``factor`` rows; bytes on disk don't show that."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() * factor / TASK_ROWS))


def spread(df: DataFrame, factor: int) -> DataFrame:
    """The same rows, dealt over as many tasks as their work needs.

    Spark moves filters before a repartition; of rows that come out of an array it doesn't, so filters on
    costly columns run where the rows were dealt to.
    """
    return df.repartition(task_count(df, factor)).select(F.inline(F.array(F.struct(*df.columns))))


def fixture(name: str, text: str) -> None:
    FIXTURES[name] = text.strip()


def _needed(text: str, seen: list[str]) -> None:
    for n in _PLACEHOLDER.findall(text):
        if n in FIXTURES and n not in seen:
            _needed(FIXTURES[n], seen)
            seen.append(n)


def oracle(select: str, ctes: dict[str, str] | None = None) -> str:
    """DuckDB text: the fixtures it needs as CTEs, then its own CTEs, then the query."""
    ctes = ctes or {}
    seen: list[str] = []
    for text in [*ctes.values(), select]:
        _needed(text, seen)

    def plain(text: str) -> str:
        text = _HEX.sub(r"cast(('0x' || \1) as bigint)", text)
        return _PLACEHOLDER.sub(r"\1", text)

    parts = [f"{n} AS ({plain(FIXTURES[n])})" for n in seen] + [f"{n} AS ({plain(t)})" for n, t in ctes.items()]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + plain(select)


def query(name: str, items: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` for inventory ``items``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, items, fn, oracle(sql, ctes) if sql else None)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so that two engines print the same value."""
    def one(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name)
        return F.col(f.name)
    return df.select(*[one(f) for f in df.schema.fields])


def rnd(expr: str, name: str, digits: int = 6) -> str:
    """The SQL twin of :func:`rounded` for one column."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# The letters that stand for hexadecimal digits in derived
# sequences. T, V, W and Y never occur there, so a mutation to one of them
# always changes the residue.
_AA16 = "ACDEFGHIKLMNPQRS"


def chain_sequence(chain: str, key: str) -> str:
    return f"translate(md5(concat('{chain}|', cast({key} as string))), '0123456789abcdef', '{_AA16}')"


_LINE_ID = (
    "md5(concat(cast(l_orderkey as string), '|', cast(l_linenumber as string), '|', cast(l_partkey as string), '|', "
    "cast(l_suppkey as string), '|', cast(cast(l_quantity as bigint) as string), '|', "
    "cast(cast(round(l_extendedprice * 100) as bigint) as string)))"
)

fixture("scored", f"""
SELECT concat('s', cast(l_suppkey as string)) AS grp, l_extendedprice AS label, l_quantity AS pred, {_LINE_ID} AS rid
FROM {{lineitem}}
UNION ALL SELECT 'flat_pred', cast(n_nationkey as double), 1.0D0, n_name FROM {{nation}}
UNION ALL SELECT 'flat_label', 2.5D0, cast(n_nationkey as double), n_name FROM {{nation}}
UNION ALL SELECT 'few_rows', cast(r_regionkey as double), cast(5 - r_regionkey as double), r_name FROM {{region}}
UNION ALL SELECT concat('one_', r_name), 1.0D0, 2.0D0, r_name FROM {{region}}
""".replace("D0", "E0"))

fixture("scored_events", """
SELECT event_type AS grp, value AS label,
       value * 0.5E0 + @HEX(substr(md5(cast(event_id as string)), 1, 4))@ / 65536E0 * 20E0 AS pred,
       event_id AS rid
FROM {events}
""")

fixture("folds", """
SELECT cast(l_orderkey % 5 as int) AS fold, ln(l_extendedprice) AS truth, ln(l_quantity * p_retailprice) AS pred,
       l_suppkey AS model, l_orderkey, l_linenumber
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""")

fixture("affinity", """
SELECT o_orderkey AS row_idx,
       CASE WHEN o_orderkey % 97 = 0 THEN '<0.5'
            WHEN o_orderkey % 101 = 0 THEN NULL
            WHEN o_orderkey % 103 = 0 THEN '0'
            WHEN o_orderkey % 107 = 0 THEN 'n.d.'
            ELSE concat(cast(cast(floor(o_totalprice) as bigint) as string), '.5') END AS kd_text,
       o_orderpriority AS ag_name, o_orderstatus AS profile
FROM {orders}
""")

fixture("clustered", """
SELECT o_orderkey AS row_idx,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE concat('c', cast(o_custkey as string)) END AS cluster,
       o_totalprice AS affinity, o_orderstatus AS status
FROM {orders}
""")

fixture("strata", f"""
SELECT {_LINE_ID} AS rid, concat(l_returnflag, '_', l_linestatus) AS stratum, l_extendedprice AS price FROM {{lineitem}}
""")

fixture("wt", "\nUNION ALL ".join(
    f"SELECT concat('p', cast(p_partkey as string)) AS poi, '{c}' AS chain, {chain_sequence(c, 'p_partkey')} AS seq FROM {{part}}"
    for c in "HLA"
))

# Two candidate sites per line item; the second one is used for every third order.
_SITE1 = "(1 + cast(l_quantity as int) % 32)"
_SITE2 = "(1 + cast((l_partkey + 5 * l_linenumber) % 32 as int))"
_NEW1 = "substr('TVWY', cast(1 + l_orderkey % 4 as int), 1)"
_NEW2 = "substr('WYTV', cast(1 + l_partkey % 4 as int), 1)"


def _token(seq: str, pos: str, new: str) -> str:
    return f"concat(substr({seq}, {pos}, 1), cast({pos} as string), {new})"


fixture("heavy_mut", f"""
SELECT rid, poi, label, seq,
       CASE WHEN l_orderkey % 41 = 0 THEN 'WT'
            WHEN l_orderkey % 43 = 0 THEN 'bad'
            WHEN l_orderkey % 47 = 0 THEN concat('A', cast(40 + l_linenumber as string), 'T')
            WHEN l_orderkey % 3 = 0 AND p1 <> p2 THEN concat({_token('seq', 'p1', _NEW1)}, ':', {_token('seq', 'p2', _NEW2)})
            ELSE {_token('seq', 'p1', _NEW1)} END AS mutant
FROM (SELECT {_LINE_ID} AS rid, concat('p', cast(l_partkey as string)) AS poi, l_extendedprice AS label, l_orderkey, l_linenumber, l_partkey,
             {chain_sequence('H', 'l_partkey')} AS seq, {_SITE1} AS p1, {_SITE2} AS p2 FROM {{lineitem}}) l
""")

# Multi-chain assay rows: chain maps are written as literals, one row in 211
# uses a plain mutation string and one in 223 has no mutation at all.
def _literal_map(**values: str) -> str:
    """SQL that writes a chain map as a literal with single quotes."""
    body = ", ', ', ".join(f"chr(39), '{k}', chr(39), ': ', chr(39), {v}, chr(39)" for k, v in values.items())
    return f"concat(chr(123), {body}, chr(125))"


_MUT_MAP = _literal_map(
    H=f"CASE WHEN l_linenumber % 3 = 0 OR l_orderkey % 3 = 0 THEN {_token('h', 'p1', _NEW1)} ELSE '' END",
    L=f"CASE WHEN l_linenumber % 3 = 1 THEN {_token('l', 'p2', _NEW2)} WHEN l_linenumber % 3 = 2 THEN 'nan' ELSE '' END",
    A=f"CASE WHEN l_linenumber % 3 = 2 AND l_partkey % 2 = 0 THEN {_token('a', 'p1', _NEW2)} ELSE '' END",
)
fixture("assay", f"""
SELECT rid, poi, label, CASE l_partkey % 4 WHEN 0 THEN 'HLA' WHEN 1 THEN 'H,L,A' WHEN 2 THEN 'A L H' ELSE '' END AS chain_id,
       {_literal_map(H='h', L='l', A='a')} AS wildtype_sequence,
       CASE WHEN l_orderkey % 211 = 0 THEN 'A5T' WHEN l_orderkey % 223 = 0 THEN '' ELSE {_MUT_MAP} END AS mutant
FROM (SELECT {_LINE_ID} AS rid, concat('p', cast(l_partkey as string)) AS poi, l_extendedprice AS label, l_orderkey, l_linenumber, l_partkey,
             {chain_sequence('H', 'l_partkey')} AS h, {chain_sequence('L', 'l_partkey')} AS l, {chain_sequence('A', 'l_partkey')} AS a,
             {_SITE1} AS p1, {_SITE2} AS p2 FROM {{lineitem}}) x
""")

fixture("residues", " UNION ALL ".join(f"SELECT '{a}' AS aa" for a in "ACDEFGHIKLMNPQRSTVWY"))
fixture("positions", " UNION ALL ".join(f"SELECT {i} AS pos" for i in range(1, 33)))

# Model outputs as a long table: one logit per (sequence, position, residue).
fixture("logits", """
SELECT concat('p', cast(p_partkey as string)) AS poi, pos, aa,
       ((p_partkey * 31 + pos * 17 + ascii(aa) * 13) % 997) / 100E0 AS logit
FROM {part} CROSS JOIN {positions} CROSS JOIN {residues}
""")
fixture("chain_logits", """
SELECT concat('p', cast(p_partkey as string)) AS poi, chain, pos, aa,
       ((p_partkey * 31 + pos * 17 + ascii(aa) * 13 + ascii(chain) * 7) % 997) / 100E0 AS logit
FROM {part} CROSS JOIN (SELECT 'H' AS chain UNION ALL SELECT 'L' UNION ALL SELECT 'A') c
CROSS JOIN {positions} CROSS JOIN {residues}
""")

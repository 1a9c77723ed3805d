"""Run registered queries against their SQL twins: ``python tests/oracle_check.py SF_DIR [name part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import types as T

from seqrank.plans.registry import BASE_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v if isinstance(v, (int, str)) else str(v)


def kind(t) -> str:
    t = str(t).upper()
    for k, names in {"float": ("DOUBLE", "FLOAT", "DECIMAL"), "int": ("INT", "BIGINT", "HUGEINT", "LONG", "SMALLINT", "TINYINT"),
                     "str": ("VARCHAR", "STRING"), "bool": ("BOOL",)}.items():
        if any(t.startswith(n) for n in names) and not t.endswith("]"):
            return k + ("!" if t.startswith(("DECIMAL", "HUGEINT")) else "")
    return "other"


def compare(spark, fn, sql, sf_dir, con=None):
    """Return (ok, message)."""
    con = con or connect(sf_dir)
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = [tuple(_norm(x) for x in (r.asDict(recursive=True)[c] for c in cols)) for r in df.collect()]
    if sql is None:
        return len(left) > 0, f"rows only: {len(left)}"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} != {sorted(rel.columns)}"
    kinds = {c: kind(t) for c, t in zip(rel.columns, rel.types)}
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    bad = [(c, mine[c], kinds[c]) for c in cols if mine[c] != kinds[c] and "other" not in (mine[c], kinds[c])]
    order = [rel.columns.index(c) for c in cols]
    right = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    if bad:
        return False, f"types {bad}"
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    a, b = sorted(left, key=repr), sorted(right, key=repr)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(diff)} rows differ, e.g. {str(cols)[:200]} {str(diff[0])[:900]}"
    return True, f"{len(left)} rows"


def connect(sf_dir):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from seqrank.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name in qs:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, msg = compare(spark, qs[name], sqls.get(name), sf_dir)
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", msg, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)

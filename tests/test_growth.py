"""Plans and results of steps that must grow no faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqrank.functions import ordering
from seqrank.operators import clean, metrics, mutations


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_maps_are_parsed_after_the_join(spark):
    rows = [("a", "p", "H L", "{'H': 'AAA', 'L': 'CC'}", "{'H': '', 'L': 'C1A'}"), ("b", "p", "H L", "{'H': 'AAA', 'L': 'CC'}", "{'H': 'A2C', 'L': 'C2A'}"), ("c", "p", "H L", "{'H': 'AAA', 'L': 'CC'}", "'A1C'"), ("d", None, "H", "{'H': 'AAA'}", "{'H': 'A1C'}")]
    df = spark.createDataFrame(rows, "rid string, poi string, chain_id string, wildtype_sequence string, mutant string")
    table = spark.createDataFrame([("p", "AAACC", ["H", "L"], [0, 3])], "poi string, wt_concat string, chains array<string>, offsets array<int>")
    out = mutations.globalize_mutations(df, "rid", "poi", table=table)
    assert {r["rid"]: r["mutant_global"] for r in out.collect()} == {"a": "C4A", "b": "A2C:C5A", "c": "A1C"}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(mutations.globalize_mutations(df, "rid", "poi", table=table).select("rid", "mutant_global"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "from_json" in text.split("SortMergeJoin")[0] and "from_json" not in text.split("SortMergeJoin")[1]


def test_quarantine_sorts_no_rows(spark):
    rows = [("a", "0"), ("a", " 0.0 "), ("b", "0"), ("b", "1"), ("c", None), (None, "0"), ("d", "x"), ("a", "0")]
    df = spark.createDataFrame(rows, "file string, v string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved, kept, counts = clean.quarantine_all_zero(df, "file", "v")
        assert "SortMergeJoin" not in plan(moved) + plan(kept)
        assert sorted(r["file"] for r in moved.collect()) == ["a", "a", "a"]
        assert sorted(r["file"] or "" for r in kept.collect()) == ["", "b", "b", "c", "d"]
        assert tuple(counts.first()) == (5, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_large_groups_are_sorted_as_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "with_position", None)  # the levels take no part
    r = random.Random(3)
    rows = [(g, r.randrange(9), i) for g in ("a", "b", None) for i in range(200)] + [("few", 1, 0)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    got = ordering.with_positions(df, ["g"], {"i": ["x", "id"], "j": ["i"]}, total="n", window_rows=50).collect()
    assert len(got) == 601
    for g in ("a", "b", None, "few"):
        want = {id_: i for i, (_, id_) in enumerate(sorted((x, i) for h, x, i in rows if h == g))}
        assert {q["id"]: q["i"] for q in got if q["g"] == g} == want
        assert all(q["i"] == q["j"] and q["n"] == len(want) for q in got if q["g"] == g)


def test_cells_of_one_point_are_not_counted(spark, monkeypatch):
    sizes = []
    count = metrics.strip_inversions
    monkeypatch.setattr(metrics, "strip_inversions", lambda i, *a: sizes.append(len(i)) or count(i, *a))
    taken = {}
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", lambda self, fn, schema: taken.setdefault(len(taken), fn) and spark.createDataFrame([], schema))
    metrics._inversions(spark.createDataFrame([(0, 0, 0, 1)], "_g int, i long, j long, n long").withColumn("_g", F.struct("_g")), 2000, 1000)
    import pandas as pd

    part = pd.DataFrame({"_key": "k", "i": [5000, 1, 9000, 2], "j": [0, 1, 2, 3], "n": 1})
    # Three of six pairs are inverted: 5000 with 1 and 2, 9000 with 2; the pair of 1 and 2 is one cell.
    assert taken[1](part)["discordant"].tolist() == [3.0]
    assert sizes == [4, 2]


def test_stars_need_no_round(spark, monkeypatch):
    near = pytest.importorskip("seqrank.llm.near_copies")
    names, keep = [], near.written
    monkeypatch.setattr(near, "written", lambda df, name: names.append(name) or keep(df, name))
    key = lambda n: bytes([n])

    def comps(pairs):
        names.clear()
        got = near.components(spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary"), "t")
        return sorted((r["node"][0], r["comp"][0]) for r in got.collect())

    assert comps([(2, 1), (1, 3), (5, 4), (7, 7), (2, 1)]) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert names == ["t-edges"]
    assert comps([(i, i + 1) for i in range(1, 30)] + [(40, 41)]) == [(i, 1) for i in range(1, 31)] + [(40, 40), (41, 40)]
    assert comps([]) == []


def test_scored_files_are_read_once(spark, sf_dir):
    out = entry.queries()["correlate_scored_files"](spark, sf_dir)
    assert "FileScan text" not in plan(out)

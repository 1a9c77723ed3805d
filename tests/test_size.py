"""Steps that write, compare or compute less than before, with the same results; all rows are built here."""

import random

import pytest
from pyspark.sql import functions as F

from seqrank.operators import clusters as CL
from seqrank.operators import records as J
from seqrank.operators import scoring as S

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def families(spark):
    """40 families of 12 near copies; the representative of each is its longest, then first row."""
    r, rows = random.Random(4), []
    for _ in range(40):
        base = r.choices(LETTERS, k=60)
        for _ in range(12):
            copy = list(base)
            for at in r.sample(range(60), 2):
                copy[at] = r.choice(LETTERS)
            rows.append("".join(copy))
    return spark.createDataFrame(list(enumerate(rows)), "row_idx long, seq string").cache()


def test_all_seeds_are_read_of_representatives_only(families, monkeypatch):
    """Near copies meet by a few seeds; each sequence had all its seeds shuffled."""
    real, seen = CL.seed_pairs, []

    def watched(seqs, shapes, turn, *few):
        seen.append((bool(few) and few[0] is not None, seqs.count()))
        return real(seqs, shapes, turn, *few)

    monkeypatch.setattr(CL, "seed_pairs", watched)
    got = {r["row_idx"]: r["representative"] for r in CL.cluster_sequences(families, "seq", min_identity=0.8).collect()}
    assert got == {i: i - i % 12 for i in range(480)}
    assert max(n for few, n in seen if not few) < 120


@pytest.mark.parametrize("shift", [0, -5, 1 << 41])
def test_ids_of_any_rows(spark, families, shift):
    """Row numbers that fit into the id, and others; null rows take no part, and texts may repeat or be null."""
    rows = families.filter("row_idx < 24").select((F.col("row_idx") + F.lit(shift)).alias("row_idx"), "seq")
    more = spark.createDataFrame([(None, "ACDEFGHIKL" * 3), (shift + 30, None), (shift + 31, ""), (shift + 32, rows.filter(F.col("row_idx") == shift).first()["seq"])], "row_idx long, seq string")
    got = sorted((r["row_idx"], r["representative"]) for r in CL.cluster_sequences(rows.unionByName(more), "seq").collect() if r["row_idx"] is not None)
    assert got == [(shift + i, shift + i - i % 12) for i in range(24)] + [(shift + 30, shift + 30), (shift + 31, shift + 30), (shift + 32, shift)]


def test_refused_edges_are_left_out_before_merging(spark, monkeypatch):
    """Representatives choose among the edges that all their members allow, in one pass and not by trial."""
    a, b, c = "A" * 20, "A" * 17 + "CCC", "A" * 14 + "CCCCCC"
    seqs = spark.createDataFrame([(0, a, 20), (1, b, 20), (2, c, 20), (3, b, 20), (4, "D" * 20, 20)], "id long, seq string, len int")
    settled = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 3), (4, 4)], "id long, representative long")
    edges = spark.createDataFrame([(1, 0, 0.15), (3, 1, 0.0)], "id long, center long, d double")
    real, calls = CL.settle, []
    monkeypatch.setattr(CL, "settle", lambda e: calls.append(1) or real(e))
    out, n = CL._merged(seqs, settled, edges, False, 0.8, 0.8)
    # 1 may not join 0, as its member 2 differs from 0 in six letters, so it represents 3.
    assert {r["id"]: r["representative"] for r in out.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4} and n == 1
    assert len(calls) == 1
    none = CL._merged(seqs, settled, edges.filter("id = 1"), False, 0.8, 0.8)
    assert none[1] == 0 and sorted(map(tuple, none[0].collect())) == sorted(map(tuple, settled.collect()))


def _candidates(spark, n=6):
    r = random.Random(1)
    word = lambda k: "".join(r.choices("ACDE", k=k))
    return spark.createDataFrame(
        [(f"s{i}", "T", word(8), word(9), word(8), [(1, 4)], i) for i in range(n)],
        "record_id string, target string, epitope string, vh string, vl string, hcdr_ranges array<struct<start:int,end:int>>, row_idx long")


def _counted(spark, value):
    """A column function that counts the rows it is computed for."""
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return value(x)

    return F.udf(one, "double").asNondeterministic(), seen


def test_children_are_scored_once(spark):
    """A beam step whose rows are read several times makes and scores its children once."""
    score, seen = _counted(spark, lambda x: float(x.count("A")))
    best = J.beam_step(J.as_candidates(_candidates(spark)), lambda df: df.withColumn("score", score("vh")), 10)
    assert J._placed(best).count() == 10 and best.count() == 10
    assert [r["score"] for r in best.collect()] == sorted([r["score"] for r in best.collect()], reverse=True)
    assert seen.value == J.enumerate_children(J.as_candidates(_candidates(spark))).count()


def test_records_of_a_search_are_made_once(spark):
    """Their chains are located once, not for every step that reads the parents."""
    keep, seen = _counted(spark, lambda x: float(len(x)))
    records = _candidates(spark).withColumn("_n", keep("vh")).filter("_n > 0").drop("_n")
    out = J.beam_search(records, lambda df: df.withColumn("score", F.length(F.replace("vh", F.lit("A"), F.lit(""))).cast("double")), rounds=2, beam=3, final=5)
    assert out.count() == 5 and seen.value == 6


def test_site_scores_equal_the_fold(spark):
    """Texts of all lengths at once, with nulls, empty texts and other alphabets."""
    from seqrank.plans.record_queries import _scorer

    r = random.Random(2)
    rows = ["".join(r.choices(LETTERS, k=r.choice([1, 5, 32, 33]))) for _ in range(200)] + [None, "", "é", "aß\U0001d53cz"]
    df = spark.createDataFrame([(x,) for x in rows], "vh string")
    want = df.withColumn("score", F.expr("aggregate(sequence(1, length(vh)), 0D, (s, i) -> s + ((ascii(substring(vh, i, 1)) * (i % 7 + 1)) % 23))"))
    assert sorted(map(str, _scorer(df).collect())) == sorted(map(str, want.collect()))
    assert "ArrowEvalPython" in plan(_scorer(df))


def _outputs(spark):
    return spark.createDataFrame(
        [(k, p, x, float((p * 7 + ord(x) * 3 + (k == "b")) % 11)) for k in "abc" for p in (1, 2, 3) for x in "ACD"], "poi string, pos int, aa string, logit double")


def test_chain_outputs_without_sites_end_before_the_softmax(spark):
    """Positions are asked before the windows of a softmax; scores are those of all outputs."""
    lp = S.log_softmax(_outputs(spark).withColumn("chain", F.lit("H")), ["poi", "chain", "pos"])
    chains = spark.createDataFrame([(k, ["H"], [0]) for k in "ab"], "poi string, chains array<string>, offsets array<int>")
    muts = spark.createDataFrame([("1", "a", "A1C:D3A"), ("2", "a", "A9C"), ("3", "b", "C2D"), ("4", "d", "A1C"), ("5", None, "A1C"), (None, "a", ""), ("3", "b", "A2C")], "rid string, poi string, mutant_global string")
    out = S.score_per_chain(muts, lp, chains, "rid", "poi")
    v = {(r["poi"], r["pos"], r["aa"]): r["logprob"] for r in lp.collect()}
    d = lambda k, p, x, y: v[k, p, y] - v[k, p, x]
    got = {r["rid"]: r["score"] for r in out.collect()}
    assert got.pop("1") == pytest.approx(d("a", 1, "A", "C") + d("a", 3, "D", "A")) and got.pop("3") == pytest.approx(d("b", 2, "C", "D") + d("b", 2, "A", "C"))
    assert got == {"2": 0.0, "4": None, "5": 0.0, None: 0.0}
    text = plan(out)
    assert text.index("Window") < text.index("LeftSemi")
    twice = lp.unionByName(lp)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        S.score_per_chain(muts, twice, chains, "rid", "poi").collect()


def test_two_temperatures_take_one_pass(spark):
    """One window for the maxima and one for the sums of both temperatures; the values are those of one at a time."""
    odd = spark.createDataFrame([("a", 1, "A", None), ("a", 1, "C", 1e300), ("b", 1, "A", float("inf")), ("c", 1, "A", -800.0), ("c", 1, "C", -801.0)], "poi string, pos int, aa string, logit double")
    rows = _outputs(spark).unionByName(odd)
    both = S.log_softmaxes(rows, ["poi", "pos"], {"x": 1.0, "y": -1.5})
    x, y = (S.log_softmax(rows, ["poi", "pos"], temperature=t, out=n) for n, t in (("x", 1.0), ("y", -1.5)))
    assert sorted(map(str, both.drop("y").collect())) == sorted(map(str, x.collect()))
    assert sorted(map(str, both.drop("x").collect())) == sorted(map(str, y.collect()))
    muts = spark.createDataFrame([("1", "a", "A2C")], "rid string, poi string, mutant string")
    assert plan(S.score_temperature(muts, _outputs(spark), "rid", "poi")).count("Window [") == 2


def test_paired_outputs_without_sites_are_not_grouped(spark):
    """Light outputs come after the heavy chain and its separator; only positions with a site become maps."""
    rows = _outputs(spark).withColumnRenamed("logit", "logprob")
    lp = rows.unionByName(rows.select("poi", (F.col("pos") + 4).alias("pos"), "aa", (F.col("logprob") * 2).alias("logprob")))
    muts = spark.createDataFrame(
        [("1", "a", "A1C", "C2D", "ACD", "CCC"), ("2", "a", "", "D2A", "ACD", "CCC"), ("3", "b", "A1D", "", "ACD", "AAA"), ("4", "c", "A1C", "", "ACD", None), ("5", "x", "A1C", "", "ACD", "A"), (None, "a", "", "", "A", "A")],
        "rid string, poi string, mh string, ml string, h string, l string")
    out = S.score_paired(muts, lp, "rid", "poi", "mh", "ml", "h", "l")
    v = {(r["poi"], r["pos"], r["aa"]): r["logprob"] for r in rows.collect()}
    got = {r["rid"]: r["score"] for r in out.collect()}
    assert got == {"1": v["a", 1, "C"] - v["a", 1, "A"] + 2 * (v["a", 2, "D"] - v["a", 2, "C"]), "2": None, "3": v["b", 1, "D"] - v["b", 1, "A"], "4": 0.0, "5": 0.0, None: 0.0}
    assert "LeftSemi" in plan(out)


def test_residues_of_a_sequence_stay_together(spark, tmp_path):
    """Probabilities by sequence and letter are grouped where they are made."""
    from seqrank.plans import scoring_queries as Q
    from seqrank.plans.registry import Tables

    spark.range(1, 30).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    for name, key in (("logits", None), ("chain_logits", None), ("chain_logits", "key")):
        laid, whole = t.model_outputs(name, key), t.model_outputs(name, key, whole=True)
        assert laid.exceptAll(whole).isEmpty() and whole.exceptAll(laid).isEmpty()
    assert "ENSURE_REQUIREMENTS" not in plan(Q.residue_probability(t))


def test_observed_letters_never_become_rows(spark):
    """A sequence meets its outputs as one row; repeated and null keys, letters outside and empty ones."""
    lp = spark.createDataFrame(
        [("a", p, x, -float(p) - (x == "C")) for p in (-1, 0, 1, 2, 9) for x in ("A", "C", "")] + [("b", 1, None, -1.0), (None, 1, "A", -1.0), ("c", 1, "é", -3.0)], "key string, pos int, aa string, logprob double")
    seqs = spark.createDataFrame([("a", "AC"), ("a", "AA"), ("b", "A"), (None, "A"), ("c", "éA"), ("d", None)], "key string, seq string")
    out = S.pseudo_loglik(lp, seqs, "key", "seq")
    assert sorted((r["key"] or "", r["pll"]) for r in out.filter("key IN ('a', 'c')").collect()) == [("a", -1.75), ("a", -1.75), ("c", -3.0)]
    assert [r["pll"] for r in out.filter("key IS NULL OR key NOT IN ('a', 'c')").collect()] == [None, None, None]
    assert "Generate" not in plan(S.pseudo_loglik(spark.range(9).selectExpr("'a' key", "int(id) pos", "'A' aa", "1D logprob"), spark.range(9).selectExpr("'a' key", "'A' seq"), "key", "seq"))


def test_tasks_of_model_outputs_hold_a_million_rows(spark):
    """Each is sorted in memory, beside others on the same executor."""
    from seqrank.plans.registry import OUTPUTS_PER_PART, task_count

    assert task_count(spark.range(200_000), OUTPUTS_PER_PART) >= 128


def test_queries_are_listed_without_a_session():
    """The driver asks for them before it starts Spark."""
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert int(out.stdout) > 150

"""Golden cases, error paths and brute-force comparisons of the other operators."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from seqrank.functions import mutation_text as MT
from seqrank.functions import text as X
from seqrank.operators import alignments as K
from seqrank.operators import clean as C
from seqrank.operators import clusters as CL
from seqrank.operators import metrics as M
from seqrank.operators import records as J
from seqrank.operators import reports as I
from seqrank.operators import scoring as S
from seqrank.plans.scoring_queries import TOY_WEIGHTS
from seqrank.sources import sequences as Q
from seqrank.sources import tables as A

DEMO = [("synthetic_001", "A1V", 0.10, "VCDEFGHIK", 0.12), ("synthetic_002", "C2S", 0.30, "ASDEFGHIK", 0.28),
        ("synthetic_003", "D3E", 0.70, "ACEEFGHIK", 0.70), ("synthetic_004", "F5Y", 0.90, "ACDEYGHIK", 0.89),
        ("synthetic_005", "H7R", 0.55, "ACDEFGRIK", 0.54)]


def test_demo_table(spark):
    rows = [(i, "ACDEFGHIK", m, y) for i, m, y, _, _ in DEMO]
    df = spark.createDataFrame(rows, "mutation_id string, wildtype_sequence string, mutant string, DMS_score double")
    out = I.add_scores(df, TOY_WEIGHTS)
    assert out.columns == ["mutation_id", "mutant", "wildtype_sequence", "mutated_sequence", "DMS_score", "mock_score"]
    got = {r["mutation_id"]: (r["mutated_sequence"], r["mock_score"]) for r in out.collect()}
    assert got == {i: (s, pytest.approx(v)) for i, _, _, s, v in DEMO}
    wide = M.evaluate(out.withColumn("k", F.lit(1)), ["k"], "DMS_score", "mock_score")
    long = I.metrics_long(wide, ["k"], ["spearman", "auc", "mcc", "ndcg", "ap"]).collect()
    assert {r["metric"] for r in long} == {"spearman", "auc", "mcc", "ndcg", "ap"}
    assert [r["value"] for r in long if r["metric"] == "spearman"] == [pytest.approx(1.0)]


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_offset_round_trip(spark):
    assert _one(spark, MT.shift_mutations("m", 2, undo=True), m="A1C:G3D") == "A2C:G4D"
    assert _one(spark, MT.shift_mutations("m", 2), m="A2C:G4D") == "A1C:G3D"


@pytest.mark.parametrize("mutant", ["bad", "A5C", "C1D", "A1B", "A0C"])
def test_bad_mutations_raise(spark, mutant):
    with pytest.raises(Exception):
        _one(spark, MT.apply_mutations("s", "m"), s="ACDE", m=mutant)
    assert _one(spark, MT.apply_mutations("s", "m", on_error="null"), s="ACDE", m=mutant) is None


def test_old_residue_is_checked_against_the_unmutated_sequence(spark):
    assert _one(spark, MT.apply_mutations("s", "m"), s="ACDE", m="A1C:C2D") == "CDDE"
    assert _one(spark, MT.apply_mutations("s", "m"), s="ACDE", m="A1C:A1D") == "DCDE"


def test_strict_parse_raises(spark):
    with pytest.raises(Exception, match="cannot parse"):
        _one(spark, MT.parse_mutations_strict("m"), m="A1")


@pytest.mark.parametrize(("mutant", "want"), [("WT", "ACDE"), ("", "ACDE"), ("A1C:A1C", "CCDE"), ("A9C", "ACDE"), ("C1A", "ACDE")])
def test_checked_application(spark, mutant, want):
    assert _one(spark, MT.apply_mutations_checked("s", "m"), s="ACDE", m=mutant) == want


def test_checked_conflict_raises(spark):
    with pytest.raises(Exception, match="conflicting"):
        _one(spark, MT.apply_mutations_checked("s", "m"), s="ACDE", m="A1C:A1D")


def test_wild_type_mismatch_in_scoring(spark):
    lp = spark.createDataFrame([("p", i, a, 0.0) for i in range(1, 5) for a in "ACDE"], "poi string, pos int, aa string, logprob double")
    muts = spark.createDataFrame([("r", "p", "C1D", "ACDE")], "rid string, poi string, mutant string, seq string")
    with pytest.raises(Exception, match="old residue"):
        S.score_delta_logprob(muts, lp, "rid", "poi", seq="seq").collect()
    assert S.score_delta_logprob(muts, lp, "rid", "poi", seq="seq", on_mismatch="null").first()["score"] is None
    for text in ("", "WT", "nan"):
        empty = spark.createDataFrame([("r", "p", text)], "rid string, poi string, mutant string")
        assert S.score_delta_logprob(empty, lp, "rid", "poi").first()["score"] == 0.0


@pytest.mark.parametrize("window", [7, 8, 20, 33])
def test_window_plan_equals_loop(spark, window):
    lengths = list(range(1, 130))
    df = spark.createDataFrame([(n,) for n in lengths], "t int")
    got = {}
    for r in S.plan_windows_overlap(df, "t", window).collect():
        got.setdefault(r["t"], set()).add((r["kind"], r["win_start"], r["win_end"]))
    for t in lengths:
        if t <= window:
            assert got[t] == {("whole", 0, t - 1)}
            continue
        stride, left, right, want = max(1, window // 2 - 1), 0, t - window, set()
        while True:
            want |= {("left", left, left + window - 1), ("right", right, right + window - 1)}
            if left + window - 1 > right:
                break
            left, right = left + stride, right - stride
        if left + window - right < stride:
            c = max(0, t // 2 - window // 2)
            want.add(("center", c, min(t - 1, c + window - 1)))
        assert got[t] == want, t


def test_cache_runs_each_new_sequence_once(spark):
    def model(batches):
        for b in batches:
            assert not b["seq_hash"].duplicated().any()
            yield b.assign(score=1.0)[["seq_hash", "score"]]

    df = spark.createDataFrame([(1, "abc"), (2, "ABC "), (3, "xyz"), (4, "xyz")], "i int, seq string")
    cache = spark.createDataFrame([("abc",)], "s string").select(S.sequence_hash(F.col("s")).alias("seq_hash"), F.lit(9.0).alias("score"))
    rows, fresh, counts = S.infer_with_cache(df, "seq", cache, model)
    assert {r["i"]: r["score"] for r in rows.collect()} == {1: 9.0, 2: 9.0, 3: 1.0, 4: 1.0}
    assert fresh.count() == 1
    assert counts.first().asDict() == {"hits": 1, "misses": 1}


def test_cluster_invariants(spark):
    """Equal sequences share a cluster; members meet the limits against a representative that represents itself."""
    import random

    rng = random.Random(4)
    rows = []
    for fam in range(12):
        base = [rng.choice(MT.RESIDUES) for _ in range(60)]
        for _ in range(15):
            s = list(base)
            for _ in range(rng.randint(0, 5)):
                s[rng.randrange(60)] = rng.choice(MT.RESIDUES)
            rows.append("".join(s)[: rng.randint(55, 60)])
    rows += rows[:10] + ["", "AC"]
    df = spark.createDataFrame(list(enumerate(rows)), "row_idx long, seq string")
    got = {r["row_idx"]: r["representative"] for r in CL.cluster_sequences(df, "seq", min_identity=0.8).collect()}
    assert set(got) == set(range(len(rows)))
    by_text = {}
    for i, s in enumerate(rows):
        assert by_text.setdefault(s, got[i]) == got[i]
    assert all(got[r] == r for r in got.values())
    check = spark.createDataFrame([(rows[i], rows[r]) for i, r in got.items()], "a string, b string")
    worst = check.select(F.min(CL.sequence_identity(F.col("a"), F.col("b"))).alias("i"), F.min(F.length("a") / F.greatest(F.length("b"), F.lit(1))).alias("c")).where("1 = 1").first()
    assert worst["i"] >= 0.8
    assert len(set(got.values())) < 40


def test_record_loading(spark, tmp_path):
    lines = ["ID,ELISA_status,H,HCDR1,HCDR2,HCDR3,L,Antigen,Antigen_sequence",
             "a,positive,EVQLGFTFSSYAMAISGSGGDRGYYFDY,GFTFSSY,AISGSGG,DRGYYFDY,DIQMT,T1,ACDEF",
             ",Positive,EVQLGFTFSSYAMAISGSGGDRGYYFDY,GFTFSSY,AISGSGG,DRGYYFDY,DIQMT,T1,ACDEF",
             "bad,positive,,AAA,CCC,DDD,ACDE,T,ACDE", "off,negative,EVQL,EV,QL,,DIQ,T,ACDE", "lost,positive,EVQL,WWW,,,DIQ,T,ACDE"]
    path = str(tmp_path / "r.csv")
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    raw = A.read_records(spark, path)
    got = {r["record_id"]: r for r in J.load_records(raw).collect()}
    assert set(got) == {"a", "record_00001"}
    r = got["a"]
    assert [(x["start"], x["end"]) for x in r["hcdr_ranges"]] == [(4, 11), (13, 20), (20, 28)]
    assert r["serialized"].startswith("1") and r["serialized"].endswith("2") and r["serialized"].count(X.LINKER) == 2
    assert r["row"] == {}
    assert "ID" in J.load_records(raw, raw_row=True).first()["row"]
    assert J.load_records(raw, active_only=False).count() == 3
    with pytest.raises(Exception, match="invalid record"):
        J.load_records(raw, skip_invalid=False).collect()
    back = J.load_records(raw).select(X.split_serialized(F.col("serialized")).alias("p"), "epitope", "vh", "vl")
    assert all((b["p"]["epitope"], b["p"]["vh"], b["p"]["vl"]) == (b["epitope"], b["vh"], b["vl"]) for b in back.collect())


def test_cdr_columns(spark):
    rows = [("A" * 20, "3-5", None, "8", "10"), ("A" * 20, "3-25", None, None, None), ("A" * 20, None, None, "0", "4")]
    df = spark.createDataFrame(rows, "vh string, hcdr1 string, hcdr2 string, hcdr2_start string, hcdr2_end string")
    got = [r["hcdr_ranges"] for r in J.cdr_ranges(df, "vh").collect()]
    assert [(x["start"], x["end"]) for x in got[0]] == [(2, 5), (7, 10)]
    assert got[1] is None and got[2] is None


def test_beam_equals_exhaustive_search(spark):
    recs = [("r1", "ACDE", [(0, 2)]), ("r2", "ACDF", [(1, 3)])]
    df = spark.createDataFrame([(i, n, "T", "EP", vh, "VL", [{"start": a, "end": b} for a, b in rg]) for i, (n, vh, rg) in enumerate(recs)],
                               "row_idx long, record_id string, target string, epitope string, vh string, vl string, hcdr_ranges array<struct<start:int,end:int>>")
    weight = {a: (i * 7) % 20 for i, a in enumerate(MT.RESIDUES)}
    table = F.create_map(*[x for k, v in weight.items() for x in (F.lit(k), F.lit(float(v)))])

    def scorer(d):
        return d.withColumn("_w", table).withColumn("score", F.expr("aggregate(sequence(1, length(vh)), 0D, (s, i) -> s + i * element_at(_w, substring(vh, i, 1)))")).drop("_w")

    def score(vh):
        return float(sum((i + 1) * weight[a] for i, a in enumerate(vh)))

    parents, seen = [(vh, rg, ()) for _, vh, rg in recs], {}
    for _ in range(2):
        kids = {}
        for vh, rg, used in parents:
            for p in dict.fromkeys(itertools.chain(*[range(a, b) for a, b in rg])):
                if p not in used:
                    for aa in MT.RESIDUES:
                        if aa != vh[p]:
                            kids.setdefault(vh[:p] + aa + vh[p + 1:], (vh[:p] + aa + vh[p + 1:], rg, used + (p,)))
        ranked = sorted(kids.values(), key=lambda c: -score(c[0]))
        for c in ranked:
            seen.setdefault(c[0], score(c[0]))
        parents = ranked[:8]
    want = sorted(seen.values(), reverse=True)[:15]
    got = J.beam_search(df, scorer, rounds=2, beam=8, final=15).collect()
    assert sorted((r["score"] for r in got), reverse=True) == want
    table = J.candidate_table(J.beam_search(df, scorer, rounds=1, beam=8, final=5)).orderBy("rank").collect()
    assert [r["rank"] for r in table] == [1, 2, 3, 4, 5]
    assert table[0]["seed_id"] == "seed_00001" and table[0]["target"] == "redacted"


@pytest.mark.parametrize("mode", ["max", "min"])
def test_diverse_rows_equal_brute_force(spark, mode):
    import hashlib
    import random

    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACD-") for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(seqs)), "row_idx long, seq string")
    order = sorted(range(40), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    picks = [order[0]]
    far = lambda a, b: sum(x != y for x, y in zip(seqs[a], seqs[b])) / 12
    while len(picks) < 12:
        sign = 1 if mode == "max" else -1
        picks.append(max((i for i in order if i not in picks), key=lambda i: (round(sign * sum(far(i, p) for p in picks), 9), -order.index(i))))
    got = {r["row_idx"]: r["pick"] for r in K.greedy_diverse(df, n=12, mode=mode, seed=3).collect()}
    assert got == {p: i for i, p in enumerate(picks)}


@pytest.mark.parametrize("mode", ["max", "min"])
def test_diverse_rows_of_any_length_and_letters(spark, mode):
    """More picks than settle rounds, families, ragged rows and letters beyond ASCII: as a plain loop."""
    import hashlib
    import random

    rng = random.Random(4)
    roots = ["".join(rng.choice("ACDEFGHIK-") for _ in range(30)) for _ in range(6)]
    seqs = ["".join(c if rng.random() < 0.8 else rng.choice("ACD-") for c in rng.choice(roots)) for _ in range(90)]
    seqs += [seqs[0], seqs[0][:11], "\u00c5" * 30, "", "A" * 8, "A" * 16]
    df = spark.createDataFrame(list(enumerate(seqs)), "row_idx long, seq string")
    order = sorted(range(len(seqs)), key=lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())

    def far(a, b):
        n = min(len(seqs[a]), len(seqs[b]))
        return sum(x != y for x, y in zip(seqs[a], seqs[b])) / n if n else 0.0

    picks, sign = [order[0]], 1 if mode == "max" else -1
    while len(picks) < 14:
        picks.append(max((i for i in order if i not in picks), key=lambda i: (round(sign * sum(far(i, p) for p in picks), 9), -order.index(i))))
    got = {r["row_idx"]: r["pick"] for r in K.greedy_diverse(df, n=14, mode=mode, seed=5, settle_every=4).collect()}
    assert got == {p: i for i, p in enumerate(picks)}


def test_diverse_budget(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["AAAA", "CC--", "DDDD", "EEEE", "FFFF"])], "row_idx long, seq string")
    got = K.greedy_diverse(df, budget=6, seed=1).count()
    assert 3 <= got <= 4
    assert K.greedy_diverse(df, budget=100).count() == 5


def test_axis_order(spark):
    rows = [("H", "<", "", "<"), ("H", "33", " ", "C"), ("H", "33", "A", "D"), ("H", "33", "B", "E"), ("H", "32", "A", "F"), ("H", "32", " ", "G"), ("H", ">", "", ">"), ("H", "5", " ", "-")]
    df = spark.createDataFrame(rows, "chain string, position string, insertion string, residue string")
    got = [(r["position"], r["insertion"].strip()) for r in K.numbering_axis(df).orderBy("axis_idx").collect()]
    assert got == [("<", ""), ("32", ""), ("32", "A"), ("33", "B"), ("33", "A"), ("33", ""), (">", "")]


def test_spread_vectors(spark):
    rows = [(1, "H", "1", " ", "A", [1.0, 2.0]), (2, "H", "2", " ", "C", [3.0, 4.0]), (1, "L", "7", " ", "D", [5.0, 6.0])]
    df = spark.createDataFrame(rows, "id int, chain string, position string, insertion string, residue string, v array<double>")
    got = {r["id"]: r for r in K.align_to_axis(df, K.numbering_axis(df), "id", vec="v").collect()}
    assert (got[1]["aligned"], got[2]["aligned"]) == ("A-|D", "-C|-")
    assert got[2]["aligned_vectors"] == [[0.0, 0.0], [3.0, 4.0], [0.0, 0.0]]


def test_mixed_headers_and_missing_scores(spark, tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    (tmp_path / "m" / "a.csv").write_text("DMS_score,x_score\n1,2\n2,3\nbad,4\n")
    (tmp_path / "m" / "sub" / "b.csv").write_text("y_score,note,DMS_score\n5,n,1\n6,n,2\n")
    (tmp_path / "m" / "c.csv").write_text("DMS_score\n1\n")
    (tmp_path / "m" / "d.csv").write_text("DMS_score,x_score,y_score\n1,2,3\n")
    files = A.read_scored_files(spark, str(tmp_path))
    assert {r["file"]: r["status"] for r in files.select("file", "status").distinct().collect()} == {
        "a": "ok", "b": "ok", "c": "missing score", "d": "missing score"}
    assert {r["model"] for r in files.collect()} == {"m"}
    got = {r["file"]: r["n"] for r in M.evaluate(files.filter("status = 'ok'"), ["model", "file"], "label", "pred").collect()}
    assert got == {"a": 2, "b": 2}
    preferred = A.read_scored_files(spark, str(tmp_path), score_preference=("z_score", "y_score"))
    assert {(r["label"], r["pred"], r["status"]) for r in preferred.filter("file = 'd'").collect()} == {("1", "3", "ok")}
    assert {r["status"] for r in preferred.filter("file = 'a'").collect()} == {"ok"}


def test_many_headers_one_plan(spark, tmp_path):
    """Every file with a header of its own: the plan doesn't grow, values and statuses are those of a plain reader."""
    import csv

    want = {}
    for i in range(300):
        names = [f"c{i}_{j}" for j in range(i % 5)] + ["DMS_score", f"m{i}_score"][: 1 + (i % 7 > 0)] + ["note, quoted"]
        names = names[i % len(names):] + names[: i % len(names)]
        with open(tmp_path / f"f{i}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(names)
            for k in range(2):
                out.writerow([f"{i}.{k}" if c.endswith("_score") else 'say ""x"", or "y"' for c in names])
        want[f"f{i}"] = ("ok", [f"{i}.0", f"{i}.1"]) if i % 7 else ("missing score", [None, None])
    heads = A.scored_file_headers(spark, str(tmp_path))
    files = A.read_scored_files(spark, str(tmp_path), headers=heads)
    got = {}
    for r in files.orderBy("file", "row_idx").collect():
        got.setdefault(r["file"], (r["status"], []))[1].append(r["pred"])
    assert got == want
    assert {r["label"] for r in files.filter("file = 'f3'").collect()} == {"3.0", "3.1"}
    (tmp_path / "few").mkdir()
    (tmp_path / "few" / "one.csv").write_text("DMS_score,x_score\n1,2\n")
    few = A.read_scored_files(spark, str(tmp_path / "few"))
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(files) - size(few)) < 200


def test_presence_of_scores_from_headers(spark, tmp_path):
    """A column that is named but empty is there; a file without rows is listed."""
    (tmp_path / "a.csv").write_text("DMS_score,wt_score,masked_score\n1,,1\n2,,3\n")
    (tmp_path / "b.csv").write_text("DMS_score,masked_score\n1,1\n2,3\n")
    (tmp_path / "c.csv").write_text("masked_score\n1\n")
    (tmp_path / "d.csv").write_text("DMS_score,wt_score\n")
    heads = A.scored_file_headers(spark, str(tmp_path), score_preference=("wt_score", "masked_score"))
    wide = spark.createDataFrame([("a", 1.0, None, 1.0), ("a", 2.0, None, 3.0), ("b", 1.0, None, 1.0), ("b", 2.0, None, 3.0), ("c", None, None, 1.0)],
                                 "file string, DMS_score double, wt_score double, masked_score double")
    got = {r["file"]: (r["status"], r["pearson"]) for r in M.per_file_correlation(wide, "file", files=heads).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "zero variance", "b": "computed", "c": "missing", "d": "zero variance"}
    assert got["a"][1] is None and got["b"][1] == pytest.approx(1.0)
    guessed = {r["file"]: r["status"] for r in M.per_file_correlation(wide, "file").collect()}
    assert guessed == {"a": "computed", "b": "computed", "c": "missing"}


def test_a2m_parts(spark, tmp_path):
    """A folder of parts reads like one file: the first row of the first part is the query."""
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0.a2m").write_text(">q\nACDE\n>r1\nACxE\n")
    (tmp_path / "x" / "part-1.a2m").write_text(">r2\nACDC\n>r3\nWWWW\n" + "".join(f">s{i}\nWCDE\n" for i in range(500)))
    got = {r["header"]: r for r in Q.read_a2m(spark, str(tmp_path / "x")).collect()}
    assert [h for h, r in got.items() if r["is_query"]] == ["q"]
    assert (got["r1"]["identity"], got["r2"]["identity"], got["s7"]["identity"]) == (0.75, 0.75, 0.75)


def test_named_documents(spark, tmp_path):
    """One file per row, whole texts; a job that fails publishes nothing."""
    from seqrank.sources.documents import write_documents

    path = tmp_path / "docs"
    rows = spark.range(200).select(F.concat(F.lit("cand \u00e9-"), "id").alias("name"), F.when(F.col("id") != 7, F.repeat(F.lit("x\n"), F.col("id").cast("int"))).alias("value"))
    write_documents(rows.repartition(7), str(path))
    assert {p.name: p.read_text() for p in path.iterdir()} == {f"cand \u00e9-{i}.json": "" if i == 7 else "x\n" * i for i in range(200)}
    for wrong in ("a/b", "", None, "..", "cand \u00e9-3"):
        late = rows.union(spark.createDataFrame([(wrong, "new")], "name string, value string"))
        with pytest.raises(Exception, match="no document can have this name"):
            write_documents(late, str(tmp_path / "none"))
    # Tasks that still run while the job ends may leave files in the hidden staging folder, never documents.
    assert not list((tmp_path / "none").glob("*.json"))
    write_documents(rows.filter("id < 0"), str(tmp_path / "empty"))
    write_documents(rows.limit(0), str(path))
    write_documents(spark.createDataFrame([("cand \u00e9-3", "new")], "name string, value string"), str(path))
    assert (path / "cand \u00e9-3.json").read_text() == "new" and len(list(path.iterdir())) == 200


def test_required_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("mutation_id,mutant\n1,A1C\n")
    with pytest.raises(ValueError, match="DMS_score, wildtype_sequence"):
        A.read_mutations(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError):
        C.require_columns(spark.range(1), ("DMS_score",))


@pytest.mark.parametrize("text", ['[{"id": "a", "x": 1}, {"id": "b", "x": 2}]', '{"items": [{"id": "a", "x": 1}, {"id": "b", "x": 2}]}'])
def test_json_records(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    assert sorted(r["id"] for r in A.read_records(spark, str(tmp_path / "r.json")).collect()) == ["a", "b"]


def test_assay_index(spark):
    df = spark.createDataFrame([("f1",), ("f2",)], "DMS_filename string")
    assert A.resolve_assay(df, 1).first()[0] == "f2"
    with pytest.raises(Exception, match="names"):
        A.resolve_assay(df, 5).collect()


def test_split_document(spark, tmp_path):
    doc = {"meta": {"size": 3, "seed": 1}, "folds": [{"train_idx": [0], "valid_idx": [1], "test_idx": [2]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=2))
    splits, meta = A.read_splits(spark, str(tmp_path / "s.json"))
    assert {(r["fold"], r["split"], r["row_idx"]) for r in splits.collect()} == {(0, "train", 0), (0, "valid", 1), (0, "test", 2)}
    assert meta.first()["size"] == 3
    (tmp_path / "e.json").write_text(json.dumps({"meta": {}, "folds": []}))
    with pytest.raises(Exception, match="no folds"):
        A.read_splits(spark, str(tmp_path / "e.json"))[0].collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a.1 first one\nACD\nEFG\n>b\n\n>c second\nKL M\n")
    got = {r["id"]: (r["annotation"], r["seq"]) for r in Q.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"a.1": ("first one", "ACDEFG"), "c": ("second", "KLM")}
    assert "a" in {r["id"] for r in Q.read_fasta(spark, str(tmp_path / "x.fa"), drop_version=True).collect()}


def test_a2m(spark, tmp_path):
    (tmp_path / "x.a2m").write_text(">q\nACDE\n>r1 0.5 note here\nACxE\n>r2\nACD-\n")
    got = Q.read_a2m(spark, str(tmp_path / "x.a2m")).orderBy("row_idx").collect()
    assert [r["seq"] for r in got] == ["ACDE", "AC-E", "ACD-"]
    assert [r["identity"] for r in got][1:] == [0.5, 0.75]
    assert got[0]["is_query"] and got[1]["annotation"] == "note here"


def test_prediction_files(spark, tmp_path):
    for name, body in {"c1/x_summary.json": {"ranking_score": 0.5, "ipTM": 0.4}, "c1/y_Summary.json": {"Ranking_Score": 0.7},
                       "c2/confidence.json": {"iptm": 0.5, "ptm": 0.5, "fraction_disordered": 0.2, "has_clash": True}, "c3/other.json": {"ranking_score": 9}}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    best = J.best_per_candidate(A.read_predictions(spark, str(tmp_path)))
    got = {r["candidate_id"]: r["ranking_score"] for r in best.collect()}
    assert got == {"c1": 0.7, "c2": pytest.approx(0.8 * 0.5 + 0.2 * 0.5 + 0.5 * 0.2 - 100)}
    assert [r["rank"] for r in J.top_ranked(best, 1).collect()] == [1]
    with pytest.raises(ValueError):
        J.require_rows(best.filter("1 = 0"), "none")


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([("m", "n", "1", 0.1), ("m", "n", "x", 0.2)], "Model string, Net string, Fold string, Spearman double")
    b = spark.createDataFrame([("m", "n", "1", 0.9)], a.schema)
    once = I.upsert_summary(a, b)
    assert {(r["Fold"], r["Spearman"]) for r in once.collect()} == {(1, 0.9), (0, 0.2)}
    assert sorted(I.upsert_summary(once, b).collect()) == sorted(once.collect())
    assert I.label_summary(a, "Spearman", "Fold", ["1", "x", "none"]).filter("Fold = 'none'").first()["n"] is None


@pytest.mark.parametrize(("hc", "lc", "want"), [("AC", None, "AC"), (None, "DE", "DE"), (None, None, "")])
def test_missing_chains(spark, hc, lc, want):
    df = spark.createDataFrame([(hc, lc)], "h string, l string")
    assert df.select(X.join_chains(F.col("h"), F.col("l")).alias("x")).first()["x"] == want
    lp = spark.createDataFrame([("p", 1, "A", 0.5)], "poi string, pos int, aa string, logprob double")
    row = df.selectExpr("'r' AS rid", "'p' AS poi", "h", "l", "'A1A' AS mh", "'' AS ml")
    assert S.score_paired(row, lp, "rid", "poi", "mh", "ml", "h", "l").first()["score"] == 0.0


def test_perplexity_without_tokens(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "loss double, tokens int")
    r = S.token_weighted_perplexity(df).first()
    assert r["loss"] is None and r["perplexity"] is None


def test_related_pairs_share_a_cluster_in_large_data(spark):
    """2 000 pairs of identity 0.9."""
    import random

    rng = random.Random(9)
    rows = []
    for _ in range(2000):
        base = [rng.choice(MT.RESIDUES) for _ in range(100)]
        other = list(base)
        for at in rng.sample(range(100), 10):
            other[at] = rng.choice(MT.RESIDUES)
        rows += ["".join(base), "".join(other)]
    df = spark.createDataFrame(list(enumerate(rows)), "row_idx long, seq string")
    got = {r["row_idx"]: r["representative"] for r in CL.cluster_sequences(df, "seq", min_identity=0.8).collect()}
    assert sum(got[2 * i] != got[2 * i + 1] for i in range(2000)) <= 2


def test_remote_pairs_meet_as_data_grow(spark):
    """20 000 pairs of identity 0.6 at threshold 0.3, with the default arguments."""
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(20_000):
        base = rng.choices(MT.RESIDUES, k=100)
        other = list(base)
        for at in rng.sample(range(100), 40):
            other[at] = rng.choice([x for x in MT.RESIDUES if x != other[at]])
        rows += ["".join(base), "".join(other)]
    df = spark.createDataFrame(list(enumerate(rows)), "row_idx long, seq string")
    got = {r["row_idx"]: r["representative"] for r in CL.cluster_sequences(df, "seq", min_identity=0.3).collect()}
    assert len(got) == len(rows) and all(got[r] == r for r in got.values())
    # Both representatives at once would be a pair that never met; a row that joined
    # another representative has met one that is similar enough.
    assert sum(got[2 * i] == 2 * i and got[2 * i + 1] == 2 * i + 1 for i in range(20_000)) <= 20


def test_members_stay_similar_when_representatives_merge(spark):
    """A chain of sequences, each similar to the next only: members always meet the limit against their representative."""
    import random

    rng = random.Random(2)
    now, rows = rng.choices(MT.RESIDUES, k=80), []
    for _ in range(60):
        rows.append("".join(now) + "A" * rng.randint(0, 3))
        for at in rng.sample(range(80), 6):
            now[at] = rng.choice(MT.RESIDUES)
    df = spark.createDataFrame(list(enumerate(rows)), "row_idx long, seq string")
    got = {r["row_idx"]: r["representative"] for r in CL.cluster_sequences(df, "seq", min_identity=0.8, max_turns=12).collect()}
    assert set(got) == set(range(60)) and all(got[r] == r for r in got.values()) and len(set(got.values())) < 30
    check = spark.createDataFrame([(rows[i], rows[r]) for i, r in got.items()], "a string, b string")
    assert check.agg(F.min(CL.sequence_identity(F.col("a"), F.col("b")))).first()[0] >= 0.8
    assert CL.cluster_sequences(df.limit(0), "seq").collect() == []


def test_missing_outputs_and_wild_types_are_null(spark):
    lp = spark.createDataFrame([("a", 1, "A", -1.0), ("a", 1, "C", -3.0)], "poi string, pos int, aa string, logprob double")
    muts = spark.createDataFrame([(1, "a", "A1C"), (2, "b", "A1C"), (3, "b", "WT"), (4, "a", "A9C")], "rid long, poi string, mutant string")
    got = {r["rid"]: r["score"] for r in S.score_delta_logprob(muts, lp, "rid", "poi").collect()}
    assert got == {1: -2.0, 2: None, 3: 0.0, 4: 0.0}
    scores = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "poi string, score double")
    delta = {r["poi"]: r["delta"] for r in S.delta_vs_wildtype(scores, scores.filter("poi = 'a'"), "poi").collect()}
    assert delta == {"a": 0.0, "b": None}


def test_composition_cleans_the_whole_sequence(spark):
    from seqrank.operators import features as H

    df = spark.createDataFrame([("ac d-e",), ("A" * 600 + "u1",), (None,)], "seq string")
    rows = [r["c"] for r in df.select(H.composition_vector("seq").alias("c")).collect()]
    assert rows[0][-1] == 0.0 and sum(rows[0]) == 1.0 and rows[1][0] == 600 / 601 and sum(rows[2]) == 0.0


def test_malformed_and_quoted_chain_literals(spark):
    from seqrank.operators import mutations as MU

    rows = spark.createDataFrame([("p", "'A1C'"), ("p", '"A1C"'), ("p", "A1C")], "poi string, m string")
    assert {r["_global"] for r in MU._parsed(rows, "poi", "m").collect()} == {"A1C"}
    with pytest.raises(Exception, match="malformed chain map"):
        spark.createDataFrame([("{'H': 'A1C'",)], "m string").selectExpr(MU.chain_map("m") + " AS x").collect()


@pytest.mark.parametrize(("reg", "width"), [(0.0, 1024), (0.3, 1024), (0.3, 2)])
def test_cross_validation_against_normal_equations(spark, reg, width):
    """All folds from one set of moments, and the iterative form, against a ridge fit of each training set."""
    import numpy as np

    from seqrank.operators import features as H

    r = np.random.default_rng(3)
    n, d, k = 240, 4, 3
    x = r.normal(size=(n, d)) * [1.0, 10.0, 0.1, 2.0] + [100.0, 0.0, -5.0, 3.0]
    y = x @ [0.5, -0.2, 4.0, 0.0] + r.normal(size=n) + 50
    rows = [(i, None if i == 7 else x[i].tolist(), None if i == 11 else float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_idx long, v array<double>, y double").repartition(7)
    splits = spark.createDataFrame([(f, "test" if i % k == f else "valid" if i % 10 == f else "train", i) for f in range(k) for i in range(n) if not (f == 2 and i > 200)], "fold int, split string, row_idx long")
    got = {(p["fold"], p["row_idx"]): (p["truth"], p["pred"]) for p in H.cross_validate(df, splits, "v", "y", reg_param=reg, max_width=width).collect()}
    assert len(got) == sum(1 for f in range(k) for i in range(n) if i % k == f and not (f == 2 and i > 200))
    for f in range(k):
        train = [i for i in range(n) if i % k != f and i % 10 != f and i not in (7, 11) and not (f == 2 and i > 200)]
        a, b = x[train], y[train]
        sa, sb = a.std(0), b.std()
        z, w = (a - a.mean(0)) / sa, (b - b.mean()) / sb
        beta = np.linalg.solve(z.T @ z / len(train) + reg * np.eye(d), z.T @ w / len(train)) / sa * sb
        for (g, i), (truth, pred) in got.items():
            if g == f:
                assert (pred is None) == (i == 7) and (truth is None) == (i == 11)
                assert i == 7 or abs(pred - (b.mean() + (x[i] - a.mean(0)) @ beta)) < (1e-7 if width > d else 0.05)


def test_moments_of_degenerate_features(spark):
    import numpy as np

    from seqrank.operators import features as H

    rows = np.array([[1.0, 2.0, 2.0, 5.0], [1.0, 3.0, 3.0, 7.0], [1.0, 5.0, 5.0, 11.0], [1.0, 0.0, 0.0, 1.0]])
    weights, intercept = H.Moments.of(rows).line(0.0)
    assert np.allclose(rows[:, :3] @ weights + intercept, rows[:, 3]) and weights[0] == 0.0
    part = H.Moments.of(rows[:3]).merged(H.Moments.of(rows[3:]))
    back = part.merged(H.Moments.of(rows[3:]), -1)
    assert np.allclose(part.products, H.Moments.of(rows).products) and np.allclose(back.products, H.Moments.of(rows[:3]).products)
    df = spark.createDataFrame([(1, None, 1.0)], "row_idx long, v array<double>, y double")
    splits = spark.createDataFrame([(0, "test", 1)], "fold int, split string, row_idx long")
    assert H.cross_validate(df, splits, "v", "y").first()["pred"] is None


def test_pooled_vectors(spark):
    from seqrank.operators import features as H

    res = spark.createDataFrame([("a", 0, [1.0, 2.0], 1), ("a", 1, [3.0, 6.0], 1), ("a", 2, [9.0, 9.0], 0), ("b", 0, [4.0, 4.0], 0), ("c", 0, None, 1)], "k string, pos int, vec array<double>, m int")
    assert {r["k"]: r["vec"] for r in H.pool_residues(res, "k", mask="m").collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    both = H.concat_branches(res.selectExpr("vec AS hc", "cast(NULL AS array<double>) AS lc", "vec AS ag")).collect()
    assert len(both) == 5 and all(len(r["features"]) == 4 and not r["lc_present"] for r in both)


def test_potency_that_is_no_number(spark):
    df = spark.createDataFrame([(1, "5"), (2, " 50 "), (3, ""), (4, None), (5, "n.d.")], "i long, ec50 string")
    assert [r["i"] for r in J.filter_potency(df, "ec50", 10).collect()] == [1]
    assert [r["i"] for r in J.filter_potency(df.filter("i < 5"), "ec50", 10, skip_invalid=False).collect()] == [1]
    with pytest.raises(Exception, match="potency is no number: n.d."):
        J.filter_potency(df, "ec50", 10, skip_invalid=False).collect()


def test_bucketed_cache_is_not_shuffled(spark):
    seqs = spark.range(500).selectExpr("id", "concat('acd', id % 400) AS seq")
    cached = seqs.filter("id % 3 = 0").select(S.sequence_hash(F.col("seq")).alias("seq_hash"), F.lit(-1.0).alias("score")).distinct()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = S.save_cache(cached, "seqrank_test_cache", 8)
        wanted = seqs.select(S.sequence_hash(F.col("seq")).alias("seq_hash"), "seq").dropDuplicates(["seq_hash"])
        plan = S.looked_up(wanted, cache, "score")._jdf.queryExecution().executedPlan().toString()
        # The one that groups the wanted sequences.
        assert plan.count("Exchange") == 1

        def model(batches):
            for b in batches:
                yield b.assign(score=b["seq"].str.len().astype("float64"))[["seq_hash", "score"]]

        rows, fresh, counts = S.infer_with_cache(seqs, "seq", cache, model)
        hits = cached.count()
        assert counts.first()[:] == (hits, 400 - hits) and fresh.count() == 400 - hits
        got = {r["id"]: r["score"] for r in rows.collect()}
        known = {f"acd{i % 400}" for i in range(0, 500, 3)}
        assert got == {i: -1.0 if f"acd{i % 400}" in known else float(len(f"acd{i % 400}")) for i in range(500)}
    finally:
        spark.sql("DROP TABLE IF EXISTS seqrank_test_cache")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pseudo_loglik_broadcasts_no_residues(spark):
    """Sequences look small, but their residues are one row each; missing letters, positions and texts."""
    import math

    from seqrank.operators import scoring as S

    lp = spark.createDataFrame(
        [("a", p, x, -0.5 * p - (x == "C")) for p in (1, 2, 3) for x in "AC"] + [("b", 1, "A", None), (None, 1, "A", -1.0)],
        "key string, pos int, aa string, logprob double")
    seqs = spark.createDataFrame([("a", "ACWAA"), ("b", "A"), ("c", "AC"), ("d", ""), ("e", None), (None, "A")], "key string, seq string")
    out = S.pseudo_loglik(lp, seqs, "key", "seq")
    got = {r["key"]: r["pll"] for r in out.collect()}
    assert math.isclose(got.pop("a"), -1.25) and got == {"b": None, "c": None, "d": None, "e": None, None: None}
    observed = spark.range(10).selectExpr("concat('k', id) AS key", "'ACDEFGHIKL' AS seq")
    text = S.pseudo_loglik(lp, observed, "key", "seq")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in text and "], Inner, Build" not in text


def _built_rows(spark, tmp_path, parts=40, customers=30):
    """A folder with parts and customers of its own; Tables reads nothing else in these tests."""
    from seqrank.plans.registry import Tables

    spark.range(1, parts + 1).selectExpr("id AS p_partkey", "concat('n', id) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, customers + 1).selectExpr(
        "id AS c_custkey", "concat('C', id) AS c_name", "'X' AS c_mktsegment", "1.5D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    return Tables(spark, str(tmp_path))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_outputs_are_the_fixture_and_meet_by_position(spark, tmp_path):
    """Same rows as the fixture text; softmax, restoring and scoring move no residues."""
    import re

    from seqrank.operators import scoring as S
    from seqrank.plans.registry import FIXTURES

    t = _built_rows(spark, tmp_path)
    for name in ("logits", "chain_logits"):
        parts = {n: t(n) for n in set(re.findall(r"\{(\w+)\}", FIXTURES[name]))}
        plain, laid = spark.sql(FIXTURES[name], **parts), t(name)
        assert laid.schema.simpleString() == plain.schema.simpleString()
        assert plain.exceptAll(laid).isEmpty() and laid.exceptAll(plain).isEmpty()
    assert "ENSURE_REQUIREMENTS" not in _plan(S.log_softmax(t("logits"), ["poi", "pos"]).groupBy("poi", "pos").count())
    keyed = t.model_outputs("chain_logits", "key")
    assert keyed.filter("key <> concat(poi, '/', chain) OR key IS NULL").isEmpty()
    seqs = spark.createDataFrame([("p1/H", "A*C")], "key string, seq string")
    plan = _plan(S.restore_masked(seqs, keyed, "key", "seq"))
    assert "ShuffledHashJoin" in plan and not re.search(r"hashpartitioning\(key#\d+, pos#\d+, \d+\), ENSURE[^\n]*\n[^\n]*BroadcastNestedLoopJoin", plan)


def test_chain_scores_move_sites(spark):
    """Sites meet the outputs of the chain that reaches there; unknown complexes are null; overlapping chains raise."""
    import math

    import pytest

    from seqrank.operators import scoring as S

    lp = spark.createDataFrame(
        [("a", c, p, x, -0.5 * p - (x == "C") - 3.0 * (c == "L")) for c in "HL" for p in (1, 2) for x in "AC"], "poi string, chain string, pos int, aa string, logprob double")
    chains = spark.createDataFrame([("a", ["L", "H"], [0, 2]), ("b", ["H"], [0]), ("c", [], [])], "poi string, chains array<string>, offsets array<int>")
    muts = spark.createDataFrame(
        [("1", "a", "A1C:C4A"), ("2", "a", "C3A"), ("3", "a", "A9C"), ("4", "a", ""), ("5", "b", "A1C"), ("6", "c", "A1C"), ("7", "d", ""), ("8", "d", "A1C"), ("9", "a", "A1T")],
        "rid string, poi string, mutant_global string")
    got = {r["rid"]: r["score"] for r in S.score_per_chain(muts, lp, chains, "rid", "poi").collect()}
    assert math.isclose(got.pop("1"), 0.0, abs_tol=1e-12) and math.isclose(got.pop("2"), 1.0)
    assert got == {"3": 0.0, "4": 0.0, "5": None, "6": None, "7": 0.0, "8": None, "9": 0.0}
    # The residues take no part in a shuffle by chain, only in the one by position.
    assert "ENSURE_REQUIREMENTS" not in _plan(lp.repartition(8, "poi", "chain", "pos").groupBy("poi", "chain", "pos").count())
    both = spark.createDataFrame([("a", ["L", "H"], [0, 0])], "poi string, chains array<string>, offsets array<int>")
    with pytest.raises(Exception, match="overlap"):
        S.score_per_chain(muts.filter("rid = '1'"), lp, both, "rid", "poi").collect()


def test_children_of_unlike_parents_are_not_compared(spark):
    """The dedupe sees children of parents that share a third of their text only, and still drops each double."""
    import random

    from seqrank.operators import records as J

    r = random.Random(5)
    word = lambda n: "".join(r.choice("ACDE") for _ in range(n))
    rows = [(f"s{i}", "T", word(12), word(9), word(12), [(1, 4), (3, 6)]) for i in range(12)]
    twin = rows[0]
    for i, vh in enumerate([twin[3], "CC".join([twin[3][:1], twin[3][3:]]), twin[3][:2] + "W" + twin[3][3:]]):
        rows.append((f"t{i}", "T", twin[2], vh, twin[4], [(1, 4)]))
    rows += [("n", "T", None, "ACDEF", "AC", [(0, 2)]), ("o", "T", "AC", "ACD", "AC", [(1, 5)]), ("e", "T", "AC", "ACD", "ACC", [])]
    schema = "record_id string, target string, epitope string, vh string, vl string, hcdr_ranges array<struct<start:int,end:int>>, row_idx long"
    parents = J.as_candidates(spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], schema))
    got = J.enumerate_children(parents)
    spots = parents.withColumn("_spots", J.cdr_positions("hcdr_ranges"))
    every = J._children(spots, 1)
    want = J.first_rows(every, ["serialized"], [J.F.col("parent_rank"), J.F.col("_spot"), J.F.col("_aa")])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert want.count() < every.count() and "Union" in _plan(got)


def test_structure_inputs_are_computed_once(spark):
    """An input that is an expression is computed once per row, not for every letter."""
    from seqrank.functions.text import structure_tokens

    rows = spark.createDataFrame([("ABC", "XYZ", [90.0, 10.0, None]), ("AB", "XYZ", [90.0]), ("", "X", None), (None, "X", [99.0]), ("A", None, [1.0]), (None, None, None)],
                                 "a string, b string, c array<double>")
    out = rows.select(structure_tokens(_twice_reversed("a"), _twice_reversed("b"), _twice_reversed("c", False)).alias("t"))
    assert [r["t"] for r in out.collect()][:2] == ["AxB#Cz", "AxBy"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(a") == 1


def _twice_reversed(c, text=True):
    from pyspark.sql import functions as F

    return F.reverse(F.reverse(c)) if text else F.col(c)


def test_small_tables_are_dealt_out_by_work(spark, tmp_path):
    """Rows of few bytes that become many, or cost much, are spread first; windows of a supplier stay in their task."""
    from seqrank.plans import record_queries as R
    from seqrank.plans import scoring_queries as Q
    from seqrank.plans.registry import TASK_ROWS, task_count

    t = _built_rows(spark, tmp_path)
    records = R._records(t, active_only=False)
    assert "RoundRobinPartitioning" in _plan(records) and "RLIKE" not in _plan(records).split("RoundRobinPartitioning")[1]
    assert task_count(spark.range(TASK_ROWS // 100), 2000) == 20
    spark.range(5).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert "ENSURE_REQUIREMENTS" not in _plan(Q.blend_windows(t))

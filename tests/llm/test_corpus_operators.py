"""Classifiers, mixing, neighbours, near copies and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from seqrank.llm import mixing, near_copies, neighbours, quality, queries, toxicity


def auc(y, s):
    order = np.argsort(np.argsort(s)) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("query, column, folds, held, least", [(queries.op1_quality, "quality", 5, 0, 0.95), (queries.op8_toxicity, "toxic", 4, 2, 0.9)])
def test_classifiers_on_held_out_documents(spark, query, column, folds, held, least):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few labels to judge by
    rows = query(spark, sf).collect()
    assert len(rows) == 10000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    y, s = np.array([a for a, _ in out]), np.array([b for _, b in out])
    assert auc(y, s) >= least


def test_toxicity_learns_from_few_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(truth[r["doc_id"]], r["score"]) for r in queries.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert auc(np.array([a for a, _ in out]), np.array([b for _, b in out])) >= 0.9


def test_classifier_edges(make_docs, labels):
    docs = make_docs(["plain words here", "LOUD!! WORDS!!"])
    for op in (quality, toxicity):
        model = op.fit(docs, labels.limit(0))
        got = op.score(docs, model).collect()
        assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
        assert op.score(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, toxicity.Model({}, -3.0)).columns == docs.columns


def test_quality_gradients():
    r = np.random.default_rng(0)
    m = quality.GatedAttention(hidden=4, gates=3)
    x, counts, y = r.normal(size=(7, quality.FEATURES)) / 5, np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(m.forward(x, counts)[0]) + (1 - y) * np.log(1 - m.forward(x, counts)[0])).mean())
    g = m.gradients(x, counts, y)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_quality_does_not_depend_on_the_batch():
    texts = ["one two three\n" * 50, "", "É" * 5000, "x"]
    x, n = quality.encode(texts)
    alone = [quality.encode([t]) for t in texts]
    assert n.tolist() == [int(c[0]) for _, c in alone] and np.array_equal(x, np.concatenate([a for a, _ in alone]))
    assert n[2] <= quality.MAX_PASSAGES


def test_swaps_lower_the_weight_of_group_terms():
    names = ["attack", "muslims", "christians", "idiot"]
    rows = [[0, 1, 3]] * 30 + [[1]] * 10 + [[2]] * 30 + [[0, 2]] * 10
    other = [[0, 2, 3]] * 30 + [[2]] * 10 + [[1]] * 30 + [[0, 1]] * 10
    y = np.array([1.0] * 30 + [0.0] * 50)
    pairs = list(zip(rows, other))
    free, held = toxicity.train(names, rows, pairs, y, penalty=0.0), toxicity.train(names, rows, pairs, y)
    gap = lambda m: abs(m.weights.get("muslims", 0) - m.weights.get("christians", 0))
    assert gap(held) < 0.2 * gap(free) and held.weights["idiot"] > 1


def test_counterfactuals_of_sentences():
    assert toxicity.swapped({"muslims", "went"}) == [{"jews", "went"}] and toxicity.swapped({"went"}) == []
    assert toxicity.swapped({"he", "she", "left"}) == [{"she", "left"}, {"he", "left"}]
    got = toxicity.counterfactuals("He left. She came!\nNobody here\nan Able-bodied woman, unable-bodied")
    assert got == [({"he", "left"}, {"she", "left"}), ({"she", "came"}, {"he", "came"}),
                   ({"an", "able-bodied", "woman", "unable", "bodied"}, {"an", "disabled", "man", "unable", "bodied"})]
    assert toxicity.counterfactuals("") == [] and toxicity.words_of("able-bodiedness") == {"able", "bodiedness"}


def test_penalised_training_against_a_plain_loop():
    r = random.Random(4)
    names = [f"f{i}" for i in range(6)]
    rows = [sorted(r.sample(range(6), r.randrange(0, 5))) for _ in range(12)]
    pairs = [(sorted(r.sample(range(6), 2)), sorted(r.sample(range(6), 3))) for _ in range(5)] + [([], [1])]
    y = np.array([float(0 in x) for x in rows])
    penalty, ridge = 3.0, 0.01

    def loss(p):
        unit = lambda x: 1 / (1 + math.exp(-(p[-1] + sum(p[j] for j in x))))
        fitted = -sum(math.log(unit(x) if t else 1 - unit(x)) for x, t in zip(rows, y)) / len(rows)
        return fitted + ridge / 2 * sum(w * w for w in p[:-1]) + penalty * sum((unit(a) - unit(b)) ** 2 for a, b in pairs) / len(pairs)

    base = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    p, m, v = [0.0] * 6 + [math.log(base / (1 - base))], [0.0] * 7, [0.0] * 7
    for step in range(1, 31):
        g = [(loss(p[:i] + [p[i] + 1e-5] + p[i + 1:]) - loss(p[:i] + [p[i] - 1e-5] + p[i + 1:])) / 2e-5 for i in range(7)]
        m, v = [0.9 * a + 0.1 * x for a, x in zip(m, g)], [0.999 * a + 0.001 * x * x for a, x in zip(v, g)]
        p = [w - 0.1 * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8) for w, a, b in zip(p, m, v)]
    model = toxicity.train(names, rows, pairs, y, penalty, ridge, steps=30)
    assert [model.weights.get(f, 0.0) for f in names] == pytest.approx(p[:-1], abs=1e-4) and model.bias == pytest.approx(p[-1], abs=1e-4)


def plain_targets(sizes):
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    weight = lambda i: (5, 2, 1)[i % 3]
    while free:
        level = left / sum(map(weight, free))
        full = [i for i in free if level * weight(i) > 3 * sizes[i]]
        for i in full or free:
            out[i] = 3.0 * sizes[i] if full else level * weight(i)
            left -= out[i]
        free = [i for i in free if i not in full] if full else []
    return out


@pytest.mark.parametrize("sizes", [[], [0, 0], [10, 1000, 1000, 5], [7], [2**i for i in range(12)], [4**i for i in range(10, 0, -1)] + [0, 1]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02}", f"=s{i:02}", s) for i, s in enumerate(sizes)], "source string, _s string, size long")
    got = sorted(mixing.plan(rows).collect(), key=lambda r: r["rank"])
    assert [r["target"] for r in got] == plain_targets(sizes) and [r["source_size"] for r in got] == sizes
    assert all(r["wanted"] == min(round(r["target"]), 3 * r["source_size"]) for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutations(n):
    for key in range(5):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(out.tolist()) == list(range(n))


def test_mixing_query(spark, sf_dir, documents):
    rows = queries.op4_mixing(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in documents.collect()}
    assert len(rows) == len(docs)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        size[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
    names = sorted(size)
    assert [target[s] for s in names] == plain_targets([size[s] for s in names])
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(queries.op4_mixing(spark, sf_dir).collect()) == sorted(rows)


def test_mixing_against_a_plain_loop(spark, make_docs, monkeypatch):
    """Streams without gaps, every epoch a permutation of blocks, draws per shard, and the words taken from each document."""
    monkeypatch.setattr(mixing, "CELL_SHARDS", 3)
    r = random.Random(1)
    docs = [(i, " ".join("w" * r.choice([1, 0]) + "x" for _ in range(r.choice([0, 1, 40, 700]))), r.choice(["a", "a", "a", "b", None, "c"])) for i in range(200)]
    frame = spark.createDataFrame(docs + docs[:3], "doc_id long, text string, source string")
    rows = mixing.sized(frame)
    sources = mixing.plan(rows)
    info = {p["rank"]: p for p in sources.collect()}
    placed = mixing.place(rows, sources).collect()
    block = 16
    filled = mixing.slots(sources, block, shard_slots=64).collect()
    streams = {}
    for k, p in info.items():
        mine = sorted((q["at"], q["size"], q["doc_id"], q["r"]) for q in placed if q["rank"] == k and q["size"])
        assert [a for a, *_ in mine] == [sum(n for _, n, *_ in mine[:i]) for i in range(len(mine))]
        streams[k] = [(d, c) for _, n, d, c in mine for _ in range(n)]
        assert len(streams[k]) == p["source_size"]
    taken, blocks = collections.Counter(), collections.defaultdict(list)
    for s in filled:
        taken.update(streams[s["rank"]][s["block"] * block:s["block"] * block + s["take"]])
        blocks[s["rank"], s["epoch"]].append(s["block"])
    for (k, epoch), of in blocks.items():
        p = info[k]
        whole = -(-p["source_size"] // block)
        rest = -(-(p["wanted"] - epoch * p["source_size"]) // block)
        assert len(set(of)) == len(of) == min(whole, rest) and set(of) <= set(range(whole))
    per = collections.Counter(s["rank"] for s in filled)
    total = sum(per.values())
    drawn = [np.random.default_rng([1, t]).multinomial(min(64, total - 64 * t), [per[k] / total for k in sorted(per)]) for t in range(-(-total // 64))]
    for k, n in zip(sorted(per), np.array(drawn).T):
        got = collections.Counter(s["shard"] for s in filled if s["rank"] == k)
        spare = per[k] - int(n.sum())  # below 0: the last draws are not filled; above: dealt over the shards
        assert sum(max(0, int(x) - got[t]) for t, x in enumerate(n)) == max(0, -spare) and sum(max(0, got[t] - int(x)) for t, x in enumerate(n)) == max(0, spare)
    words, plain = collections.Counter(), collections.Counter()
    for s in mixing.mix(frame, block)[1].collect():
        words[s["doc_id"]] += s["stop"] - s["start"]
    for (d, _), n in taken.items():
        plain[d] += n
    assert words == plain and sum(plain.values()) == sum(p["wanted"] for p in info.values())


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HEADS", 8)
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', int(id % 7)) as text", "concat('s', id % 300) as source").unionByName(
        spark.createDataFrame([(1000, "w " * 3000, "s0"), (1001, "w", None), (1002, "w w", "")], "doc_id long, text string, source string"))
    rows = mixing.taken_words(docs).collect()
    known = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[known[r["doc_id"]]] += r["size"]
        taken[known[r["doc_id"]]] += r["taken"]
        target[known[r["doc_id"]]] = r["target"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert len(rows) == 603 and [target[s] for s in names] == pytest.approx(plain_targets([size[s] for s in names]))
    assert all(abs(taken[s] - target[s]) <= 1 for s in names) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(mixing.taken_words(docs).collect()) == sorted(rows)


def test_mixing_edges(make_docs):
    docs = make_docs(["one two three four five"] * 30 + ["w " * 900, " \n "])
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.taken_words(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], dtype=float)
    got = collections.defaultdict(list)
    for r in queries.op9_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(v - s[ids == i][0]) < 1e-12 for i, v in got[q])
        hit += len(set(best) & {i for i, _ in got[q]})
        total += 20
    assert hit / total >= 0.9


def test_neighbours_recall_with_few_sample_rows_per_list(spark, monkeypatch):
    """2 sample rows per list, as 16 million rows have them, and 60 000 rows."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    x = np.random.default_rng(7).normal(size=(60_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = collections.defaultdict(set)
    for r in neighbours.search(table, every=200).collect():
        got[r["query_id"]].add(r["vec_id"])
    s = x[::200] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 200)] = -np.inf
    best = np.argpartition(s, -20, axis=1)[:, -20:]
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[200 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.93


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "'x' as list")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0)]
    assert neighbours.search(table.limit(0)).count() == 0


def words_set(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(docs):
    sets = [words_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if (docs[i][1] or "") == (docs[j][1] or "") or sets[i] and sets[j] and both >= 0.8 * sum((sets[i] | sets[j]).values()):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(docs) if i is not None}


def test_near_copies_against_brute_force(spark, sf_dir, documents):
    want = brute_classes([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = {r["doc_id"]: r["class_id"] for r in queries.op10_near_copies(spark, sf_dir).collect()}
    assert got == want


def test_near_copies_of_a_hub_and_edges(make_docs, monkeypatch):
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in r.integers(0, 5000, 150)]
    texts = [" ".join(base)]
    for k in range(80):
        w = list(base)
        for at in r.choice(150, 1 + k % 8, replace=False):
            w[at] = f"x{r.integers(10**9)}"
        texts.append(" ".join(w))
    texts += [texts[3], "short text", "a b c d e f g " * 300, "a b c d e f g " * 320]
    docs = make_docs(texts)
    monkeypatch.setattr(near_copies, "CELL_ROWS", 16)
    rows = near_copies.classes(docs).collect()
    assert len(rows) == docs.count()
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None} == want
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i)) == sorted(
        {r["class_id"] for r in rows if r["class_id"] is not None}) + [None]
    assert near_copies.classes(docs.limit(0)).count() == 0


def test_one_row_of_a_class_stays(spark):
    from pyspark.sql import functions as F
    a, b, c = "one two three four five six seven", "some other words that stand here alone", "the third text is of its own too"
    rows = [(None, a), (None, a), (5, b), (None, b), (7, c), (7, c), (9, c), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("_n", F.lit(1))
    got = sorted(((r["doc_id"], r["text"]) for r in near_copies.keep_one(docs).collect()), key=str)
    assert got == sorted([(None, a), (5, b), (7, c), (3, "")], key=str)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_signature_estimates_weighted_similarity():
    h = near_copies.Hasher()
    text = " ".join(f"v{i}" for i in range(400))
    a, b = (near_copies.shingles(f"{'the cat sat on a mat ' * n}{text}", h) for n in (60, 45))
    s = near_copies.signatures_of([a, b, (np.empty(0, np.uint64), np.empty(0, np.int64))])
    true = near_copies.likeness(near_copies.unit_set(*a), near_copies.unit_set(*b))
    assert abs((s[0] == s[1]).mean() - true) < 0.15
    assert np.array_equal(near_copies.signatures_of([b])[0], s[1])


def test_pipeline_stages(spark, sf_dir, documents, labels):
    docs, names = documents, documents.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            keep = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.3}
            assert {r["doc_id"] for r in out.collect()} == keep and len(keep) > 0.8 * docs.count()
        elif name == "line dedup":
            want = brute_lines_of(docs)
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want
        elif name == "near-dedup":
            want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert {r["doc_id"] for r in out.collect()} == set(want.values())
        elif name == "mixing":
            words = sum(len(r["text"].split()) for r in docs.collect())
            assert abs(sum(len(r["text"].split()) for r in out.collect()) - words) <= 20
        if k < 4:
            assert out.columns == names
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out


def brute_lines_of(docs):
    from test_text_operators import brute_lines
    return brute_lines([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])

"""Toxicity with a counterfactual penalty.

A logistic model over words and word beginnings. Every sentence of a labelled
text that mentions an identity term has a counterfactual, in which each term is
swapped for the next term of its line; the squared change of the sentence's score
is a penalty, so the model can't lean on who is mentioned and neutral mentions are
not flagged. A sentence that names all terms of a line at once would swap to
itself: it has one counterfactual per term, which swaps that term alone.

Empty and null texts have no features and get the base rate of the model.
Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, labelled_sample, labelled_texts, remainder, texts_of, written

SAMPLE_DOCUMENTS = 12000
MAX_FEATURES = 4096
MIN_DOCUMENTS = 4
# Pairs of sentence and counterfactual in the fit.
SAMPLE_SENTENCES = 20000
PENALTY = 8.0
# Ridge of a feature: the base, and a part that grows as its chi-square falls, so that
# features of chance, which small samples are full of, get small weights.
RIDGE, SHRINK = 2e-4, 0.02
# Where a sentence ends.
_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f]+\s+|\n+")

# Terms that name groups of people; a term is swapped for the next one of its
# line. One line holds one language and one grammatical form.
IDENTITY_SETS = """
man woman
men women
male female
boy girl
boys girls
he she
him her
christian muslim jewish hindu buddhist atheist
christians muslims jews hindus buddhists atheists
black white asian latino african arab
gay straight lesbian bisexual
immigrant native
immigrants natives
old young
disabled able-bodied
mann frau
männer frauen
junge mädchen
christ muslim jude
christen muslime juden
homme femme
hommes femmes
garçon fille
chrétien musulman juif
chrétiens musulmans juifs
hombre mujer
hombres mujeres
niño niña
cristiano musulmán judío
cristianos musulmanes judíos
"""


def swap_table(sets: str = IDENTITY_SETS) -> dict[str, str]:
    """Each term and its partner; a term of several lines keeps the first."""
    out: dict[str, str] = {}
    for line in sets.strip().splitlines():
        terms = line.split()
        for a, b in zip(terms, terms[1:] + terms[:1]):
            out.setdefault(a, b)
    return out


_SWAP = swap_table()
# Terms with a hyphen are one word each; all other words hold letters only.
_WORD = re.compile("|".join([rf"{t}(?![^\W\d_])" for t in _SWAP if "-" in t] + [r"[^\W\d_]+"]))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swapped(words: set[str], swap: dict[str, str] = _SWAP) -> list[set[str]]:
    """The counterfactuals of a sentence: all its terms swapped, or, where that
    gives the same words, each term alone; none without a term."""
    hit = words & swap.keys()
    every = (words - hit) | {swap[w] for w in hit}
    return [every] if every != words else [(words - {w}) | {swap[w]} for w in sorted(hit)]


def counterfactuals(text: str, swap: dict[str, str] = _SWAP) -> list[tuple[set[str], set[str]]]:
    """Pairs of words before and after the swap, sentence by sentence."""
    seen = [words_of(part) for part in _END.split(text)]
    return [(words, other) for words in seen for other in swapped(words, swap)]


def features(words: set[str]) -> set[str]:
    """Words, and the first four and five letters of longer words (marked)."""
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


class Model:
    """Weights by feature and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(features(words) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(names: list[str], rows: list[list[int]], pairs: list[tuple[list[int], list[int]]], y: np.ndarray,
          penalty: float = PENALTY, ridge: float | np.ndarray = 2e-4, steps: int = 400, rate: float = 0.1) -> Model:
    """Fit by Adam on the full batch: mean log loss + ridge + penalty * mean of
    (score(sentence) - score(swapped sentence))^2.

    ``rows`` hold the feature indexes of each text, ``pairs`` those of a sentence
    and of its counterfactual; ``ridge`` is one number or one per feature.
    """
    n, d, k = len(y), len(names), len(pairs)
    if not n:
        return Model({}, 0.0)
    flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(r) for r in lists]), np.array([j for r in lists for j in r], dtype=np.int64))
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    at, col = flat(rows)
    p_at, p_col = flat([a for a, _ in pairs])
    q_at, q_col = flat([b for _, b in pairs])
    rate_1 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w, b = np.zeros(d), np.log(rate_1 / (1 - rate_1))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        err = (squash(b + np.bincount(at, w[col], n)) - y) / n
        g, g_b = np.bincount(col, err[at], d) + ridge * w, err.sum()
        if k:
            p, q = squash(b + np.bincount(p_at, w[p_col], k)), squash(b + np.bincount(q_at, w[q_col], k))
            gap = (p - q) * (2 * penalty / k)
            p, q = gap * p * (1 - p), gap * q * (1 - q)
            g += np.bincount(p_col, p[p_at], d) - np.bincount(q_col, q[q_at], d)
            g_b += p.sum() - q.sum()
        g = np.append(g, g_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2,
        sample: int = SAMPLE_DOCUMENTS, penalty: float = PENALTY, sentences: int = SAMPLE_SENTENCES,
        max_features: int = MAX_FEATURES, min_documents: int = MIN_DOCUMENTS) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fold and
    at most ``sentences`` pairs of a sentence of theirs and its counterfactual,
    chosen by hash.

    A grouped aggregate counts the documents of each feature by label and keeps
    the ``max_features`` features with the largest chi-square among those of at
    least ``min_documents`` documents; only their indexes reach the driver, so what
    it holds is bounded by (sample + sentences) x features. The weaker a feature's
    chi-square, the stronger its ridge.
    """
    rows = labelled_texts(docs.where(F.col("text").isNotNull()), labelled_sample(labels, label, remainder(F.col("doc_id"), folds) != held, sample))

    def prepare(batch):
        for part in chunks([batch], "text"):
            texts = texts_of(part)
            pairs = [counterfactuals(t) for t in texts]
            yield {"doc_id": part.column(part.schema.get_field_index("doc_id")), "label": part.column(part.schema.get_field_index("label")),
                   "words": [sorted(words_of(t)) for t in texts], "pairs": [[{"x": sorted(a), "z": sorted(b)} for a, b in p] for p in pairs]}

    bags = written(arrow_map(rows, prepare, "doc_id long, label int, words array<string>, pairs array<struct<x: array<string>, z: array<string>>>"), "toxicity-words")

    def counted(batches):
        import pyarrow as pa
        yes: dict[str, int] = {}
        no: dict[str, int] = {}
        for batch in batches:
            for words, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into = yes if y else no
                for f in features(set(words)):
                    into[f] = into.get(f, 0) + 1
        names = list(yes.keys() | no.keys())
        for k in range(0, len(names), 50_000):
            part = names[k:k + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "yes": pa.array([yes.get(f, 0) for f in part], pa.int64()), "no": pa.array([no.get(f, 0) for f in part], pa.int64())})

    total = bags.agg(F.count(F.when(F.col("label") == 1, 1)).alias("y"), F.count(F.when(F.col("label") != 1, 1)).alias("n")).first()
    ny, nn = float(total["y"]), float(total["n"])
    counts = bags.select("words", "label").mapInArrow(counted, "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("a"), F.sum("no").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = F.pow(a * (nn - b) - b * (ny - a), 2) / ((a + b) * (ny + nn - a - b) + 1.0)
    best = counts.where(a + b >= min_documents).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(max_features)
    strength = {r["feature"]: r["chi"] * (ny + nn) / max(ny * nn, 1.0) for r in best.collect()}
    names = sorted(strength)
    ridge = RIDGE + np.array([min(1.0, SHRINK / max(strength[f], 1e-9)) for f in names])
    index = {f: i for i, f in enumerate(names)}
    pick = lambda words: sorted(index[f] for f in features(set(words)) & index.keys())

    def project(batch):
        yield {"label": batch.column(0), "x": [pick(w) for w in batch.column(1).to_pylist()]}

    def project_pairs(batch):
        yield {"x": [pick(w) for w in batch.column(0).to_pylist()], "z": [pick(w) for w in batch.column(1).to_pylist()]}

    ordered = bags.orderBy("doc_id").select("label", "words")
    got = arrow_map(ordered, project, "label int, x array<int>").toPandas()
    drawn = bags.select("doc_id", F.posexplode("pairs").alias("i", "p")).orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i").limit(sentences).select("p.x", "p.z")
    both = arrow_map(drawn, project_pairs, "x array<int>, z array<int>").toPandas()
    x = [list(r) for r in got["x"]]
    pairs = sorted((a, b) for a, b in zip(map(list, both["x"]), map(list, both["z"])) if a != b)
    return train(names, x, pairs, (got["label"].to_numpy() == 1).astype(float), penalty, ridge)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every whole text."""
    def run(batch):
        for part in chunks([batch], "text"):
            yield {"doc_id": part.column(part.schema.get_field_index("doc_id")), "score": [model.score(words_of(t)) for t in texts_of(part)]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """All columns of the documents whose score is below ``limit``."""
    names = docs.columns

    def run(batches):
        import pyarrow.compute as pc
        import pyarrow as pa
        for batch in batches:
            for part in chunks([batch], "text"):
                keep = pa.array([model.score(words_of(t)) < limit for t in texts_of(part)], pa.bool_())
                yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema).select(*names)

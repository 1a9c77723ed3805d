"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages. Each passage is encoded from the transitions
between character classes, gated attention (a tanh branch times a sigmoid
branch) weighs the passages, and a logistic unit scores the weighted mean of
their encodings. Only document labels are needed.

Passages cover the whole text: at least ``PASSAGE_BYTES`` bytes each, and longer
ones in documents that would have more than ``MAX_PASSAGES``, so a bag is
bounded while no text is left out. Empty and null texts are one empty passage.
Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, labelled_sample, labelled_texts, texts_of

PASSAGE_BYTES = 256
MAX_PASSAGES = 64
SAMPLE_DOCUMENTS = 4000
CLASSES = 16
FEATURES = CLASSES * CLASSES + 2


def _class_table() -> np.ndarray:
    """Character class of every byte: letters by case, digits, blanks, common marks,
    other symbols, and bytes of multi-byte characters."""
    t = np.full(256, 15, dtype=np.uint8)
    t[ord("a"):ord("z") + 1] = 0
    t[ord("A"):ord("Z") + 1] = 1
    t[ord("0"):ord("9") + 1] = 2
    t[0x80:0xC0] = 3
    t[0xC0:] = 4
    for code, marks in enumerate((" \t", "\n\r", ".", ",;:", "!?", "|", "'\"", "()[]{}", "-_/", "#$%&*@"), start=5):
        for m in marks:
            t[ord(m)] = code
    return t


_CLASS = _class_table()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (rows) and the number of passages of each text."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    step = np.maximum(PASSAGE_BYTES, -(-sizes // MAX_PASSAGES))
    counts = -(-sizes // step)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    classes = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int32)
    inside = np.arange(len(classes), dtype=np.int64) - np.repeat(start, sizes)
    passage = np.repeat(first, sizes) + inside // np.repeat(step, sizes)
    follows = np.append(classes[1:], 0)
    follows[np.cumsum(sizes) - 1] = CLASSES - 1
    total = int(counts.sum())
    pairs = np.bincount(passage * (CLASSES * CLASSES) + classes * CLASSES + follows, minlength=total * CLASSES * CLASSES)
    pairs = pairs.reshape(total, -1).astype(np.float32)
    length = pairs.sum(1, keepdims=True)
    share = np.sqrt(pairs / np.maximum(length, 1))
    return np.hstack([share, np.log1p(length) / 8, np.repeat(counts == 1, counts)[:, None]]).astype(np.float32), counts


class GatedAttention:
    """Encoder, gated attention and logistic unit, trained with Adam."""

    def __init__(self, hidden: int = 24, gates: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {
            "W": g(FEATURES, hidden), "b": np.zeros(hidden), "V": g(hidden, gates), "U": g(hidden, gates),
            "a": g(gates, 1), "c": g(hidden, 1), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray):
        p, begin = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((t * s) @ p["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), counts))
        weight = e / np.repeat(np.add.reduceat(e, begin), counts)
        bag = np.add.reduceat(h * weight[:, None], begin)
        score = 1 / (1 + np.exp(-np.clip((bag @ p["c"])[:, 0] + p["d"][0], -30, 30)))
        return score, (begin, h, t, s, weight, bag)

    def gradients(self, x, counts, y):
        p = self.p
        score, (begin, h, t, s, weight, bag) = self.forward(x, counts)
        d_out = (score - y)[:, None] / len(y)
        out = {"c": bag.T @ d_out, "d": d_out.sum(0)}
        d_bag = np.repeat(d_out @ p["c"].T, counts, axis=0)
        d_weight = (d_bag * h).sum(1)
        mean = np.repeat(np.add.reduceat(d_weight * weight, begin), counts)
        d_e = (weight * (d_weight - mean))[:, None]
        out["a"] = (t * s).T @ d_e
        d_ts = d_e @ p["a"].T
        d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        out["V"], out["U"] = h.T @ d_t, h.T @ d_s
        d_h = (d_bag * weight[:, None] + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        out["W"], out["b"] = x.T @ d_h, d_h.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4):
        r = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs if len(y) else 0):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                take = order[at:at + batch]
                x = np.concatenate([bags[i] for i in take]).astype(np.float64)
                g = self.gradients(x, np.array([len(bags[i]) for i in take]), y[take])
                step += 1
                for k in self.p:
                    gk = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE_DOCUMENTS) -> GatedAttention:
    """Train on at most ``sample`` labelled documents outside the held-out fold.

    What reaches the driver is bounded: ``sample`` bags of at most
    ``MAX_PASSAGES`` passages in half precision (132 MB at the default, some 20 MB
    for ordinary texts). Without labels the model stays untrained and scores all alike.
    """
    from .common import remainder

    rows = labelled_texts(docs, labelled_sample(labels, label, remainder(F.col("doc_id"), folds) != held, sample))

    def bags(batch):
        for part in chunks([batch], "text"):
            x, counts = encode(texts_of(part))
            cut = np.split(x.astype(np.float16), np.cumsum(counts)[:-1])
            yield {"doc_id": part.column(part.schema.get_field_index("doc_id")), "label": part.column(part.schema.get_field_index("label")), "bag": [c.tobytes() for c in cut]}

    got = arrow_map(rows, bags, "doc_id long, label int, bag binary").toPandas().sort_values(["doc_id", "bag"])
    data = [np.frombuffer(b, dtype=np.float16).reshape(-1, FEATURES) for b in got["bag"]]
    model = GatedAttention().fit(data, got["label"].to_numpy(dtype=np.float64))
    if not data:
        model.p["c"] *= 0
    return model


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """``doc_id, score``: probability of label 1 for every whole text."""
    def run(batch):
        for part in chunks([batch], "text"):
            x, counts = encode(texts_of(part))
            yield {"doc_id": part.column(part.schema.get_field_index("doc_id")), "score": np.round(model.forward(x, counts)[0], 9)}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")

"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are tokenized and cut into full pieces of ``size`` ids and one
remainder. The histogram of piece lengths (at most ``size`` numbers) is packed on
the driver: lengths are placed longest first, each time into the shortest pack
that has room, and only counts per packing pattern are kept. Pieces then find
their pattern by their rank among the pieces of their length.

A null text is empty and has the end id alone. Repeated rows are pieces of their
own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, texts_of, written

SIZE = 1024
END_ID = 0
LONG_RUN = 2000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """Token ids of texts.

    The fast library reads the vocabulary of the tokenizer file; texts with a very
    long run of letters or blanks, on which it takes quadratic time, and texts
    with a special token go to the tokenizer itself. Both give the same ids.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = set(self.special)
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        plain = not any(s in text for s in self.special)
        if plain and (len(text) < LONG_RUN or not self.long_run(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    @staticmethod
    def long_run(text: str) -> bool:
        """Whether characters of one kind may run on for over ``LONG_RUN``: a stride of
        probes can't miss a run without an inner change from blank to mark."""
        step = LONG_RUN // 2
        for at in range(0, len(text), step):
            window = text[at:at + step]
            parts = window.split(None, 1)
            if len(window) == step and (not parts or len(parts) == 1 and len(parts[0]) >= step - 1):
                return True
        return False


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for part in chunks(batches, "text"):
            make, rows = ids_of(path), defaultdict(list)
            for doc_id, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts_of(part)):
                ids = np.append(make(text), END_ID).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size]
                    rows["doc_id"].append(doc_id)
                    rows["start"].append(start)
                    rows["length"].append(len(piece))
                    rows["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    rows["doc_tokens"].append(len(ids))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of each packing pattern.

    Lengths are taken longest first. Open packs are kept by the room they have
    left; a length goes to the packs with the most room first, i.e. the shortest,
    and a new pack is opened when none has room (it then takes the next ones too).
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            best = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if best is None:
                fit = min(size // length, left)
                room[size - fit * length].append((left // fit, (length,) * fit))
                left %= fit
                continue
            n, pack = room[best].pop()
            use = min(n, left)
            if use < n:
                room[best].append((n - use, pack))
            room[best - length].append((use, (*pack, length)))
            left -= use
    return [p for r in sorted(room) for p in room[r]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset``, sorted: the piece of a
    length with rank r lies in the last row whose first rank is at most r."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a table that can be read again).

    Ranks among equal lengths come from salted groups, so a length that a third
    of all pieces share is spread over many tasks.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(shortest_pack_first(histogram, size))
    salts = 64 + sum(histogram.values()) // 500_000
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("_rank", rank).join(offsets, ["length", "_salt"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    shift = 1 << 48

    def run(batches):
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, order = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            row = table[np.searchsorted(keys, length * shift + order, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + order - row[:, 1]), pa.array(row[:, 3])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Tokenize once, keep the piece table, pack it."""
    return pack(written(cut(docs, tokenizer, size), "pieces"), size)

"""Language of web pages by fusing four kinds of evidence.

1. Text: hashed byte triplets against counts per language, gathered from all
   documents with a language by a grouped aggregate.
2. Declared language of the markup, 3. suffix of the address: likelihoods from
   grouped sums of the text posteriors.
4. Host: a prior smoothed by its domain, the domain by the whole corpus.

Any number of languages is scored: their counts are held in tables of
``LANGUAGES`` each, one pass over the texts per table.

Each page is left out of the sums that it is judged by. A null or empty page,
address or attribute is evidence of its own kind ("none"); a page without text
follows the other evidence. Without any labelled document the language is null.
Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, texts_of, written

BUCKETS = 1 << 14
# Languages of a table of counts, and numbers of a batch of scores.
LANGUAGES = 256
BATCH_SCORES = 1 << 22
# Triplets of a page that count as independent evidence, and the weights of the parents in smoothing.
EVIDENCE = 60.0
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 4.0, 8.0, 5.0

_TAGS = r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->|<[^>]*+>"
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])"
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def triplets(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.uint32)
    h = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(18)


def text_model(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Languages in order and their log probabilities per bucket, from all documents.

    One table per ``LANGUAGES`` of them; what reaches the driver grows with the
    number of languages, not with the documents.
    """
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), texts_of(part)):
                into = seen.get(lang)
                if into is None:
                    if len(seen) == LANGUAGES:
                        yield from told(seen)
                        seen = {}
                    into = seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                into += np.bincount(triplets(text), minlength=BUCKETS)
        yield from told(seen)

    def told(seen):
        for lang, n in seen.items():
            # A language without triplets stays one with a zero.
            at = np.flatnonzero(n) if n.any() else np.zeros(1, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    known = docs.select(F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = written(known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "triplets")
    names = sorted(r["lang"] for r in sums.select("lang").distinct().collect())
    tables = []
    for first in range(0, len(names), LANGUAGES):
        of = {name: i for i, name in enumerate(names[first:first + LANGUAGES])}
        got = sums.where(F.col("lang").between(names[first], list(of)[-1])).toPandas()
        table = np.full((len(of), BUCKETS), 0.5)
        table[got["lang"].map(of).to_numpy(dtype=int), got["bucket"].to_numpy(dtype=int)] += got["n"]
        tables.append(np.log(table / table.sum(1, keepdims=True)))
    return names, tables


def _short(value: Column) -> Column:
    """A value of at most three letters as it is, longer ones by one of 4096 hash names, so that the
    table of values is bounded (22 374 rows) and may be broadcast."""
    return F.when(F.coalesce(value, F.lit("")) == "", "none").when(F.length(value) <= 3, value).otherwise(F.concat(F.lit("#"), F.pmod(F.hash(value), F.lit(4096)).cast("string")))


def page_evidence(pages: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """``page_id, host, domain, suffix, declared, ll, p``: log likelihoods and text posterior."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    parts = F.split(host, r"\.")
    letters = F.regexp_extract(F.element_at(parts, -1), r"^([a-z]+)$", 1)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"),
        F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2)), ".").alias("domain"),
        _short(letters).alias("suffix"), _short(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1))).alias("declared"),
        F.regexp_replace(F.coalesce("html", F.lit("")), _TAGS, " ").alias("text"), F.array().cast("array<double>").alias("ll"),
    )
    kept = ("page_id", "host", "domain", "suffix", "declared")
    most = max(1, BATCH_SCORES // sum(map(len, tables)))

    def scored_by(table: np.ndarray, last: bool):
        def run(batch):
            for whole in chunks([batch], "text"):
                for at in range(0, whole.num_rows, most):
                    part = whole.slice(at, most)
                    ll = np.zeros((part.num_rows, len(table)))
                    for i, text in enumerate(texts_of(part)):
                        bucket, n = np.unique(triplets(" ".join(text.split())), return_counts=True)
                        total = n.sum()
                        if total > 2:
                            ll[i] = (table[:, bucket] @ n) * min(1.0, EVIDENCE / total)
                    before = part.column(part.schema.get_field_index("ll")).flatten().to_numpy().reshape(part.num_rows, -1)
                    ll = np.concatenate([before, ll], axis=1)
                    out = {c: part.column(part.schema.get_field_index(c)) for c in (*kept, "text")}
                    if last:
                        e = np.exp(ll - ll.max(1, keepdims=True))
                        out["p"] = list(e / e.sum(1, keepdims=True))
                    yield {**out, "ll": list(ll)}
        return run

    schema = ", ".join(f"{c} {'long' if c == 'page_id' else 'string'}" for c in kept)
    for i, table in enumerate(tables):
        last = i == len(tables) - 1
        rows = arrow_map(rows, scored_by(table, last), f"{schema}, ll array<double>, " + ("p array<double>" if last else "text string"))
    return rows


def _summed(vector: str) -> Column:
    """Element-wise sum of a vector column, a partial aggregate whose plan doesn't grow with the vector."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vector))))


def _total(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda x, y: x + y)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, lang, prob, text_lang, declared, host`` for every page."""
    names, tables = text_model(docs)
    if not names:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    seen = written(page_evidence(pages, tables), "page-evidence")
    k = len(names)

    def sums(rows: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
        """Sum of the vectors by key, and ``<name>_all``, the sum of its elements."""
        return rows.groupBy(*keys).agg(_summed(vector).alias(name)).withColumn(f"{name}_all", _total(name))

    hosts = sums(seen, ["host", "domain"], "p", "h")
    whole = [float(x) for x in (hosts.groupBy(F.lit(0).alias("_every")).agg(_summed("h").alias("w")).first() or {"w": [0.0] * k})["w"]]
    pages_n = sum(whole)
    every, base = F.lit(whole), F.lit([(w + 1.0) / (pages_n + k) for w in whole])
    prior = hosts.join(sums(hosts, ["domain"], "h", "d"), "domain").drop("domain")
    # The tables of values are bounded, see _short.
    declared = F.broadcast(sums(seen, ["declared"], "p", "c"))
    suffixes = F.broadcast(sums(seen, ["suffix"], "p", "s"))

    def without_page(counts: str | Column, i: Column) -> Column:
        return F.greatest(F.get(counts, i) - F.get("p", i), F.lit(0.0))

    def value_given(counts: str, i: Column) -> Column:
        """Log probability of the value in language i, without the page itself."""
        share = (F.col(f"{counts}_all") + 1.0) / (pages_n + 1.0)
        return F.log((without_page(counts, i) + VALUE_WEIGHT * share) / (without_page(every, i) + VALUE_WEIGHT))

    def of_host(i: Column) -> Column:
        rest = lambda c: F.greatest(F.col(f"{c}_all") - 1.0, F.lit(0.0))
        above = (without_page("d", i) + DOMAIN_WEIGHT * F.get(base, i)) / (rest("d") + DOMAIN_WEIGHT)
        return F.log((without_page("h", i) + HOST_WEIGHT * above) / (rest("h") + HOST_WEIGHT))

    joined = seen.drop("domain").join(prior, "host").join(declared, "declared").join(suffixes, "suffix")
    fused = joined.withColumn("f", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("ll", i) + value_given("c", i) + value_given("s", i) + of_host(i)))
    fused = fused.withColumn("f_max", F.array_max("f")).withColumn("p_max", F.array_max("p"))
    lang = F.lit(names)
    first = lambda a: F.get(lang, (F.array_position(F.col(a), F.col(f"{a}_max")) - 1).cast("int"))
    share = 1.0 / F.aggregate("f", F.lit(0.0), lambda x, y: x + F.exp(y - F.col("f_max")))
    return fused.select("page_id", first("f").alias("lang"), F.round(share, 9).alias("prob"), first("p").alias("text_lang"), "declared", "host")

"""Registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, digests, hard_negatives, languages, line_rules, lines, mixing, near_copies, neighbours, packing, pii, quality, toxicity
from .common import remainder, table

PREDICT_AT = 0.3


def _judged(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    base = F.filter("pii", lambda s: s["kind"] < pii.BASE_KINDS)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS[: pii.BASE_KINDS])]
    return found.select("doc_id", *counts, F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("pii")).alias("spans"), pii.scores(F.col("pii")).alias("scores"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_edited(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_kept").alias("n_kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = line_rules.examine(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"_rules.counts.{c}").alias(c) for c in line_rules.COUNTS + line_rules.TAKEN]
    return seen.select("doc_id", *counts[:5], "_rules.base_failed", "_rules.kept", *counts[5:])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality, op2_language, op3_pii, op4_mixing, op5_digest, op6_packing, op7_line_dedup, op8_toxicity, op9_neighbours, op10_near_copies,
        op11_line_rules, op12_hard_negatives, op13_centroids)
}

SQL: dict[str, str] = {
    "op7_line_dedup": lines.ORACLE.format(documents="documents") + """
SELECT doc_id, CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(kept, lambda x: x[1]), chr(10)) END AS text,
       n_lines, len(kept) AS n_kept FROM o""",
    "op11_line_rules": line_rules.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_centroids": centroids.ORACLE,
}

"""FASTA and A2M sources and the FASTA sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignments import msa_identity


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ``>`` separated files in file order: ``path, at, entry``.

    The line separator is the header mark, so large files still split into
    blocks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), text.alias("entry")).filter("entry <> ''")


def read_fasta(spark: SparkSession, path: str, drop_version: bool = False, full_line_as_id: bool = False) -> DataFrame:
    """``id, annotation, seq`` of every entry (A5); an id given twice keeps its last sequence.

    Entries without residues are left out.
    """
    rows = _entries(spark, path)
    head = F.regexp_extract("entry", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_extract("entry", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    ident = head if full_line_as_id else F.regexp_extract(head, r"^\s*(\S*)", 1)
    if drop_version:
        ident = F.regexp_replace(ident, r"(?<=.)\.[^.]*$", "")
    note = F.lit("") if full_line_as_id else F.regexp_extract(head, r"^\s*\S+\s+(.*)$", 1)
    parsed = rows.select("path", "at", ident.alias("id"), note.alias("annotation"), seq.alias("seq")).filter("seq <> ''")
    return parsed.groupBy("id").agg(F.max_by(F.struct("annotation", "seq"), F.struct("path", "at")).alias("r")).select("id", "r.*")


def write_fasta(df: DataFrame, path: str, ident: str = "id", seq: str = "seq") -> None:
    """Entries with residues as FASTA text (A5)."""
    kept = df.filter(F.coalesce(F.col(seq), F.lit("")) != "")
    kept.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def aligned_text(c: str) -> str:
    """SQL of an aligned row: upper case stays, everything else is a gap."""
    return f"regexp_replace({c}, '[^A-Z]', '-')"


def read_a2m(spark: SparkSession, path: str) -> DataFrame:
    """Aligned rows of one A2M file, or of a folder of its parts (A6): ``row_idx, header, seq, identity, annotation, is_query``.

    The first row of the first part (by name) is the query; ``row_idx`` grows within a part. Identity is the second word of the header when
    it is a number, else the share of equal columns.
    """
    rows = _entries(spark, path)
    head = F.trim(F.regexp_extract("entry", r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_extract("entry", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    parsed = rows.select(F.struct("path", "at").alias("_place"), F.col("at").alias("row_idx"), head.alias("header"), seq.alias("raw")).filter("raw <> ''")
    words = F.split("header", r"\s+")
    parsed = parsed.withColumns({
        "seq": F.expr(aligned_text("raw")),
        "_given": F.try_element_at(words, F.lit(2)),
        "annotation": F.nullif(F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " "), F.lit("")),
    })
    return msa_identity(parsed, row="_place", given="_given").drop("_given", "_place", "raw")

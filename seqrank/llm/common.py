"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it again.

    Cuts the lineage: what follows reads these files, also after an executor is
    lost, and Python work in front of it runs once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seqrank-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(labels: DataFrame, column: str, keep: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by the hash of the id: ``doc_id, label``.

    An id with several labels counts as 1 if any of them is 1; null ids and null
    labels take no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep)
    one = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, label, text`` of the labelled ids, one row each: of several texts
    of an id the one with the smallest hash, so the rows are as bounded as the ids."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``size`` bytes of text, so that the
    arrays derived from a slice stay small whatever the batch holds."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        lengths = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], dtype=np.int64)
        part = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to one dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)

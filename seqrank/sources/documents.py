"""A sink of named documents: one file per row (part of A12)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _files(path: str):
    """File system and path within it, for a plain path or an address such as ``hdfs://``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Written(WriterCommitMessage):
    """Folder of a finished task; its names stay in the folder, not on the driver."""

    folder: str


class _DocumentWriter(DataSourceArrowWriter):
    """Each task attempt writes to a folder of its own; only those of finished tasks are published.

    An attempt that is lost or runs twice leaves files in its own folder only,
    and that goes with the job's folder. Tasks that outlive a failed job may leave
    a ``_staging-*`` folder, which Spark's readers skip. Publishing is one rename per document on the driver.
    """

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path.rstrip("/"), suffix
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, staging = _files(self.staging)
        folder = f"{staging}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        for batch in iterator:
            names, values = batch.column(0), batch.column(1)
            for name, value in zip(names, values, strict=True):
                with files.open_output_stream(f"{folder}/{name.as_py()}{self.suffix}") as out:
                    out.write((value.as_py() or "").encode())
        return _Written(folder)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, path = _files(self.path)
        for message in messages:
            for found in files.get_file_info(fs.FileSelector(message.folder)):
                files.move(found.path, f"{path}/{found.base_name}")
        files.delete_dir(_files(self.staging)[1])

    def abort(self, messages: list) -> None:
        files, staging = _files(self.staging)
        files.delete_dir_contents(staging, missing_dir_ok=True)
        files.create_dir(staging, recursive=True)
        files.delete_dir(staging)


class DocumentSource(DataSource):
    """``format("named_documents")``: columns ``name`` and ``value``, one file per row."""

    @classmethod
    def name(cls) -> str:
        return "named_documents"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _DocumentWriter(self.options["path"], self.options.get("suffix", ".json"))


def write_documents(df: DataFrame, path: str, suffix: str = ".json") -> None:
    """Rows ``(name, value)`` as files ``<name><suffix>`` under ``path``.

    Documents of the same name from an earlier job are replaced, others stay. A null value is an empty
    document. An empty or null name, one that holds a slash, and a name that occurs twice end the job before any document is published.
    """
    spark = df.sparkSession
    spark.dataSource.register(DocumentSource)
    bad = F.col("name").isNull() | F.col("name").rlike("^[.]{0,2}$|/") | (F.col("_n") > 1)
    one = df.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("value"))
    checked = one.select(
        F.when(~bad, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no document can have this name, or several have it: "), F.coalesce("name", F.lit("null"))))).alias("name"), "value")
    checked.write.format("named_documents").option("suffix", suffix).mode("append").save(path)

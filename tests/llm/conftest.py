import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with the awkward cases of every test appended: null and empty texts,
    a null id and source, repeated rows and a column whose name clashes with derived ones."""
    def make(texts, edge=True):
        rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
        if edge:
            n = len(rows)
            rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (None, "no id here at all", "fr", "s1", 17), (n + 2, "same row twice", "en", "", 14), (n + 2, "same row twice", "en", "", 14)]
        from pyspark.sql import functions as F
        return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("node", F.lit("x"))

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()), StructField("row_key", StringType())])


@pytest.fixture()
def make_docs(spark):
    """Documents with an extra column whose name clashes with a helper column of the operators."""
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "clash") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)
    return make


LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(None, None, None), (None, "null id text here", "a"), (1, None, "a"), (2, "", "b"), (3, " \t\n ", None), (4, "one", "a"),
       (5, LONG, "a"), (6, "same text of some words for a test of the rules", "b"), (6, "same text of some words for a test of the rules", "b")]

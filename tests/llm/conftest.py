import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def make_docs(spark):
    """documents-shaped rows from (doc_id, text) pairs; further columns have names that operators use inside."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
        if extra:
            from pyspark.sql import functions as F

            for c in ("rep", "h", "norm", "n", "label", "_t", "_copy", "pos", "line", "leaf", "cls", "m", "score", "length", "t"):
                df = df.withColumn(c, F.lit(c))
        return df

    return make


@pytest.fixture()
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

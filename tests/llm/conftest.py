import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

# names that the operators use inside
CLASHES = ["id", "t", "words", "lines", "kept", "n", "key", "comp", "u", "v", "d", "th", "part", "start", "size",
           "shard", "sig", "bands", "cell", "vec", "c", "h1", "h2", "rep", "canon", "block", "digest", "refers_to"]


@pytest.fixture()
def make_docs(spark):
    def make(rows, clashes=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
        if clashes:
            from pyspark.sql import functions as F
            for name in CLASHES:
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make

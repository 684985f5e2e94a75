"""Explicit schemas (nothing is inferred)."""

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("original_question_vi", T.StringType()),
    T.StructField("query_vi", T.StringType()),
    T.StructField("response_vi", T.StringType()),
    T.StructField("original_question_en", T.StringType()),
    T.StructField("query_en", T.StringType()),
    T.StructField("response_en", T.StringType()),
    T.StructField("type", T.StringType()),
])

TRAINING_LOG = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("epoch", T.DoubleType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
])

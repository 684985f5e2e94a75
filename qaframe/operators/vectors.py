"""Embedding, normalisation and vector-table checks.

The default embedder is a deterministic hashed bag of words computed inside the
row: tokens (SQL expressions) -> md5 buckets -> counts -> L2 unit vector (an Arrow
UDF over all tokens of a batch, linear in them whatever the dimension).  No shuffle.  A model-backed embedder plugs in through
`embed_with_model`, an Arrow iterator UDF that loads the model once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import text as X

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def word_tokens(text: Column) -> Column:
    """array<string>: the lower-case word tokens, and empty strings where a text begins or ends with none."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT)


def token_buckets(tokens: pa.Array, dim: int) -> np.ndarray:
    """The md5 bucket of every token, -1 of an empty one; each distinct token is hashed once."""
    coded = tokens.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    heads = np.frombuffer(b"".join([md5(w).digest()[:4] for w in words]), ">u4") % dim
    buckets = np.where(np.array([bool(w) for w in words], dtype=bool), heads.astype(np.int64), -1)
    return buckets[coded.indices.to_numpy(zero_copy_only=False)]


def unit_counts(tokens: Column, dim: int) -> Column:
    """array<double>(dim): L2-normalised counts of the tokens' buckets; each token is counted once."""
    @F.arrow_udf(T.ArrayType(T.DoubleType(), False))
    def counts(column: pa.Array) -> pa.Array:
        n = len(column)
        flat = column.flatten()
        buckets = token_buckets(flat, dim)
        rows = np.repeat(np.arange(n), column.value_lengths().to_numpy(zero_copy_only=False))
        some = buckets >= 0
        c = np.bincount(rows[some] * dim + buckets[some], minlength=n * dim).astype(np.float64).reshape(n, dim)
        length = np.sqrt((c * c).sum(axis=1, keepdims=True))
        unit = np.divide(c, length, out=c, where=length > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.ravel()))
    return counts(tokens)


def hash_embed(df: DataFrame, text: str, out: str = "vector", dim: int = C.HASH_DIM,
               prefix: str | None = None) -> DataFrame:
    """Add the hashed embedding of column `text` as `out` (array<double>).
    `prefix` ("passage: " / "query: ") is prepended when given; the hashed
    embedder leaves it off by default, since it adds the same token to every
    text."""
    source = F.col(text) if prefix is None else F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, unit_counts(word_tokens(source), dim))


def sparse_entries(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, bucket, weight) for the non-zero entries of a dense vector."""
    e = X.explode_rows(df, [key], F.col(vector), "bucket", "weight")
    return e.filter(F.col("weight") != 0).select(key, F.col("bucket").cast("long").alias("bucket"), "weight")


def l2_normalize(v) -> Column:
    """Unit vector in double; a zero vector stays zero."""
    v = X.col_(v)
    return F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))),
                       lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))[0]


def norm(v) -> Column:
    v = X.col_(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def contract_status(v, dim: int, eps: float = 1e-3) -> Column:
    """'wrong_size' | 'zero' | 'not_unit' | 'ok' for a stored vector."""
    v = X.col_(v)
    n = norm(v)
    return (F.when(v.isNull() | (F.size(v) != dim), F.lit("wrong_size"))
            .when(n == 0, F.lit("zero"))
            .when(F.abs(n - 1) > eps, F.lit("not_unit"))
            .otherwise(F.lit("ok")))


def embed_with_model(df: DataFrame, text: str, out: str, load_model: Callable[[], Callable],
                     dim: int, prefix: str = C.PASSAGE_PREFIX, batch: int = 64) -> DataFrame:
    """Model slot: `load_model()` runs once per task and returns
    f(list[str]) -> array (n, dim); vectors are L2-normalised here.  Texts go
    through `batch` rows at a time; a null text counts as empty, a zero vector stays zero.

    The other columns pass through Arrow untouched."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType(), False))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in it:
            if model is None:
                model = load_model()
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                texts = [prefix + (t or "") for t in part.column(text).to_pylist()]
                m = np.asarray(model(texts), dtype=np.float64)
                if m.shape != (len(texts), dim):
                    raise ValueError(f"the model gave vectors of shape {m.shape}, not {(len(texts), dim)}")
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dim, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)

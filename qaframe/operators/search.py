"""Exact cosine top-k between a query table and a corpus table.

Exact search has to score every (query, corpus) pair, but it never needs
them as rows.  The corpus stays where it is, partitioned; each task scores
its vectors against a block of queries with numpy and keeps only its best k
per query.  Those partial lists (k rows per query per task) are the only
thing shuffled, by query id, where a row_number window (with Spark's
WindowGroupLimit) keeps the final k.

The queries are cut into blocks of bounded size (rows x dim x 8 bytes).  Where there
are several, the queries are written once, by block, and the blocks run one after
another: one is read, broadcast and searched, its ranked hits are written, and the
broadcast is released.  So the driver holds one block, however many queries there are.

Scores are computed in double and rounded to `decimals` before ranking; ties
go to the smaller corpus id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..session import scratch_dir

MAX_BLOCK_BYTES = 64 * 1024 * 1024
QUERY_SLICE = 512          # queries and corpus rows scored at once inside a task (bounds the score matrix)
ROW_SLICE = 8192

PARTIAL_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), False),
])


def best_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) of every query by (score desc, id asc)."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], scores[keep]


def score_blocks(Q: np.ndarray, batches, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query (a row of `Q`) over a stream of (ids, matrix) batches.

    Of a score matrix only the entries that reach a query's k-th best in it are
    listed, all at once; ties at that value are listed too and decided by id."""
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    for ids, M in batches:
        found = [best]
        for lo in range(0, len(ids), ROW_SLICE):
            rows = M[lo:lo + ROW_SLICE]
            for a in range(0, len(Q), QUERY_SLICE):
                S = np.round(rows @ Q[a:a + QUERY_SLICE].T, decimals)
                if len(rows) > k:
                    r, c = np.nonzero(S >= np.partition(S, len(rows) - k, axis=0)[len(rows) - k])
                else:
                    r, c = np.indices(S.shape).reshape(2, -1)
                found.append((c + a, ids[lo + r], S[r, c]))
        best = best_k(*map(np.concatenate, zip(*found)), k)
    return best


def _matrix(vectors: pd.Series | pa.Array, dim: int) -> np.ndarray:
    """Unit rows (zero vectors stay zero); a vector of another size is an error."""
    if len(vectors) == 0:
        return np.zeros((0, dim))
    column = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    if column.null_count or (column.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"a vector has not the declared size {dim}; list them with vectors.contract_status")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def search_topk(queries: DataFrame, corpus: DataFrame, k: int = C.TOP_K, floor: float | None = C.FLOOR,
                query_key: str = "query_id", query_vec: str = "vector", key: str = "id",
                vec: str = "vector", decimals: int = 6, max_block_bytes: int = MAX_BLOCK_BYTES,
                dim: int = C.HASH_DIM, score=score_blocks) -> DataFrame:
    """Top-k corpus rows per query by cosine; a zero vector scores 0.

    `dim` is the collection's declared size: a null vector or one of another
    size on either side is an error, never left out.  Returns (query_id, id,
    score, rank); rank starts at 1.  `floor` is applied after the top-k cut, as
    in the original search.  `score` finds a task's best rows (as `score_blocks` does)."""
    spark = queries.sparkSession
    q = queries.select(F.col(query_key).cast("long").alias("query_id"),
                       F.col(query_vec).cast("array<double>").alias("qv"))
    c = corpus.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("cv"))
    wrong = F.coalesce(F.size("qv") != dim, F.lit(True))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).first()
    n_q = int(stats["n"])
    if stats["wrong"]:
        raise ValueError(f"{stats['wrong']} queries have not the declared size {dim}")
    if n_q == 0:
        return spark.createDataFrame([], T.StructType([*PARTIAL_SCHEMA.fields, T.StructField("rank", T.IntegerType(), False)]))
    n_blocks = max(1, -(-n_q * dim * 8 // max_block_bytes))

    def ranked(block: pd.DataFrame):
        """Top-k of one query block, and its broadcast: the corpus is read where it is."""
        bc = spark.sparkContext.broadcast((block["query_id"].to_numpy(np.int64), _matrix(block["qv"], dim)))

        def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, Q = bc.value
            batches = ((rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(rows.column("cv"), dim))
                       for rows in it)
            query, found, scores = score(Q, batches, k, decimals)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(scores)],
                                             names=["query_id", "id", "score"])

        return rank_hits(c.mapInArrow(partial, PARTIAL_SCHEMA), k, floor), bc

    if n_blocks == 1:
        return ranked(q.toPandas())[0]
    # a block's size is bounded by max_block_bytes, up to the evenness of the hash
    base = scratch_dir(spark, "query-blocks")
    (q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
     .repartition(n_blocks, "block").write.partitionBy("block").parquet(f"{base}/queries"))
    stored = spark.read.parquet(f"{base}/queries")
    for i in range(n_blocks):
        block = stored.where(F.col("block") == i).drop("block").toPandas()
        if len(block):
            hits, bc = ranked(block)
            hits.write.mode("append").parquet(f"{base}/hits")
            bc.destroy()
    return spark.read.schema(hits.schema).parquet(f"{base}/hits")


def rank_hits(parts: DataFrame, k: int, floor: float | None) -> DataFrame:
    """Final top-k of partial lists (query_id, id, score): rank from 1, then the floor."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    out = parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out if floor is None else out.filter(F.col("score") >= floor)

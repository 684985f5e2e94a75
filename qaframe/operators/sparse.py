"""Exact cosine top-k over a floor by inverted lists with upper bounds.

A bucket's list holds the corpus vectors that are not zero there.  For every
query the buckets are put in the order of their lists' lengths, longest first, and the
first ones are left out as long as they cannot give the floor by themselves: their
part of a score is at most the length of the query's part there, and at most the sum
of the query's weights times the lists' largest weights.  A hit must then stand in one
of the other, shorter lists, which are joined.  What a candidate has scored there,
plus the most that the rest can still give (by Cauchy and Schwarz, from what is left
of both unit vectors), must reach the floor; only these pairs are scored in full.

`search_sparse` does that inside the tasks: a slice of corpus rows is turned into its
lists (the columns of a matrix), these bounds are taken from the slice's own list
lengths and largest weights, and what a slice's lists have found is scored in full at
once.  Neither entries nor candidate pairs are rows of a shuffle; only a task's best k
a query are.  In few dimensions, where a list holds most vectors, the pairs of a join
would be nearly all pairs, many times over.

`candidates` is the same by joins, for entries that are not kept as vectors.  A list is
cut into parts of about `LIST_ROWS` vectors, each with the queries that ask for it, so a
bucket that nearly all vectors share is many units of work.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from . import search
from .search import rank_hits
from .vectors import l2_normalize

LIST_ROWS = 1_000_000
FULL_SCORES = 65_536       # pairs scored in full at once
SLACK = 1e-6               # bounds are kept this much below the floor: scores are rounded


def _unit(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(name), l2_normalize(F.col(vec)).alias("vector"))


def list_sizes(entries: DataFrame) -> DataFrame:
    """(bucket, rows, top, parts): length, largest absolute weight and parts of every list."""
    return entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.abs("weight")).alias("top"),
        F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))


def joined_buckets(asked: DataFrame, sizes: DataFrame, floor: float) -> DataFrame:
    """(query_id, bucket, weight, rest): the lists that a query has to read, and the length
    of the part of the query that lies in the others."""
    longest_first = Window.partitionBy("query_id").orderBy(F.col("rows").desc(), "bucket").rowsBetween(
        Window.unboundedPreceding, 0)
    w = F.col("weight")
    # as many rows as the vectors have values: bounded by their size
    bounds = asked.join(F.broadcast(sizes), "bucket").select(
        "query_id", "bucket", "weight", F.sqrt(F.sum(w * w).over(longest_first)).alias("length"),
        F.sum(F.abs(w) * F.col("top")).over(longest_first).alias("most"))
    needed = F.least("length", "most") >= floor - SLACK
    left_out = F.max(F.when(~needed, F.col("length"))).over(Window.partitionBy("query_id"))
    return bounds.select("query_id", "bucket", "weight", F.coalesce(left_out, F.lit(0.0)).alias("rest"),
                         needed.alias("needed")).where("needed").drop("needed")


def candidates(asked: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """(query_id, id) that the bounds cannot rule out."""
    sizes = list_sizes(entries).checkpoint()
    parts = F.broadcast(sizes.select("bucket", "parts"))
    lists = entries.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    reads = joined_buckets(asked, sizes, floor).join(parts, "bucket").select(
        "query_id", "bucket", F.col("weight").alias("q"), "rest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = reads.join(lists.select("bucket", "part", "id", F.col("weight").alias("w")), ["bucket", "part"])
    sums = met.groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("w")).alias("score"),
                                             F.sum(F.col("w") * F.col("w")).alias("known"), F.max("rest").alias("rest"))
    most = F.col("score") + F.col("rest") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("known")))
    return sums.where(most >= floor - SLACK).select("query_id", "id")


def score_lists(Q: np.ndarray, batches, k: int, decimals: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query (a row of `Q`) above the floor over a stream of (ids, matrix)
    batches, by the lists of slices of rows."""
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    for ids, M in batches:
        found = [best]
        for lo in range(0, len(ids), search.ROW_SLICE):
            rows = M[lo:lo + search.ROW_SLICE]
            longest_first = np.argsort(-(rows != 0).sum(axis=0), kind="stable")
            lists = rows[:, longest_first]
            squares, top = lists * lists, np.abs(lists).max(axis=0)
            for a in range(0, len(Q), search.QUERY_SLICE):
                W = Q[a:a + search.QUERY_SLICE][:, longest_first]
                length, most = np.sqrt(np.cumsum(W * W, axis=1)), np.cumsum(np.abs(W) * top, axis=1)
                needed = (W != 0) & (np.minimum(length, most) >= floor - SLACK)
                rest = np.where((W != 0) & ~needed, length, 0.0).max(axis=1)
                known = squares @ needed.T.astype(np.float64)
                bound = lists @ (W * needed).T + rest * np.sqrt(np.maximum(0.0, 1 - known))
                r, c = np.nonzero((known > 0) & (bound >= floor - SLACK))
                scores = np.empty(len(r))
                for i in range(0, len(r), FULL_SCORES):          # bounded copies of both sides
                    part = slice(i, i + FULL_SCORES)
                    scores[part] = np.einsum("ij,ij->i", rows[r[part]], Q[a + c[part]])
                scores = np.round(scores, decimals)
                hit = scores >= floor
                found.append((c[hit] + a, ids[lo + r[hit]], scores[hit]))
        best = search.best_k(*map(np.concatenate, zip(*found)), k)
    return best


def search_sparse(queries: DataFrame, corpus: DataFrame, k: int = C.TOP_K, floor: float = C.FLOOR,
                  query_key: str = "query_id", query_vec: str = "vector", key: str = "id", vec: str = "vector",
                  decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the rows of the exact search with this floor, which must
    be above zero (a vector without a bucket in common scores 0).  Rows without a key, and
    vectors that are null, hold a null or have another size than the queries', have no hits."""
    if floor <= 0:
        raise ValueError("inverted lists need a floor above zero")
    def whole(df, name, v):
        return df.where(F.col(name).isNotNull() & F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    asked, rows = whole(queries, query_key, query_vec), whole(corpus, key, vec)
    sizes = [r[0] for r in asked.select(F.size(query_vec)).distinct().collect()]
    parts = [search.search_topk(asked.where(F.size(query_vec) == n), rows.where(F.size(vec) == n), k, floor, query_key,
                                query_vec, key, vec, decimals, dim=n, score=partial(score_lists, floor=floor))
             for n in sizes or [C.HASH_DIM]]
    # a key that has vectors of several sizes is ranked over all of them
    return parts[0] if len(parts) == 1 else rank_hits(reduce(DataFrame.unionByName, parts).drop("rank"), k, floor)

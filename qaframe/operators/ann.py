"""Approximate cosine top-k over inverted cell lists.

The vectors are split into cells around centres fitted on a bounded sample
(`SAMPLE_ROWS` rows of smallest id hash, spherical k-means).  Every vector is
indexed: it lies in the list of its nearest centre, a table partitioned by cell.  A
query probes its `nprobe` nearest cells: an equi-join of (cell, query) rows with the
lists, whose candidates are scored exactly and ranked as by the exact search.

`nprobe` is chosen from measured recall: for a bounded sample of queries the exact
neighbours are found, and the cells that hold them tell how many must be probed.

Work units are bounded whatever the skew: a cell's list is cut into blocks of
about `BLOCK_ROWS` vectors, the queries of a cell into slices of about
`QUERY_ROWS`, and a task scores a block against a slice.  A cell that holds a third
of all vectors, or of all queries, is many units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import scratch_dir
from .search import rank_hits, score_blocks, search_topk

SAMPLE_ROWS = 16_384       # vectors that fit the centres
SAMPLE_QUERIES = 256       # queries that choose nprobe
MAX_CELLS = 4_096          # centres are broadcast: MAX_CELLS x dim x 8 bytes at most
BLOCK_ROWS = 8_192
QUERY_ROWS = 2_048


@dataclass
class CellIndex:
    path: str              # table (id, v, cell), by cell
    centres: np.ndarray    # one row per cell
    subs: DataFrame        # (cell, n_subs): blocks of each list


def fit_cells(sample: np.ndarray, n_cells: int, iterations: int = 12) -> np.ndarray:
    """Spherical k-means on unit rows.  The first centres are rows far from each
    other; a centre that loses all its rows takes the row farthest from its own."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    n_cells = min(n_cells, len(np.unique(sample, axis=0)))
    if n_cells == 0:
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < n_cells:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(iterations):
        scores = sample @ centres.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        for lost in np.flatnonzero(np.bincount(own, minlength=n_cells) == 0):
            far = int(np.argmin(scores.max(axis=1)))
            sums[lost] = sample[far]
            scores[far] = 1.0
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, size, out=centres.copy(), where=size > 0)
    return centres


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of an Arrow column of lists; a zero vector stays zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) != len(column) * dim or column.null_count:
        raise ValueError(f"a vector has not the declared size {dim}; list them with vectors.contract_status")
    m = flat.reshape(-1, dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest_cells(vec, centres: np.ndarray, n: int):
    """array<int>: the n nearest cells of a vector, nearest first, ties by number."""
    dim = centres.shape[1]

    @F.arrow_udf("array<int>")
    def cells(column: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(column), 4096):
            scores = np.round(_rows(column.slice(lo, 4096), dim) @ centres.T, 9)
            out.append(np.argsort(-scores, axis=1, kind="stable")[:, :n])
        found = np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()),
                                        pa.array(found.ravel(), pa.int32()))
    return cells(vec)


def _keyed(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))


def build_index(corpus: DataFrame, key: str = "id", vec: str = "vector", dim: int = C.HASH_DIM,
                n_cells: int | None = None, path: str | None = None) -> CellIndex:
    """Index every row of the corpus.  `n_cells`: by default the root of the rows, at most MAX_CELLS."""
    spark = corpus.sparkSession
    path = path or scratch_dir(spark, "cells")
    rows = _keyed(corpus, key, vec)
    n = rows.count()
    n_cells = min(MAX_CELLS, n_cells or max(1, round(n ** 0.5)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    centres = fit_cells(_rows(sample, dim), n_cells) if n else np.zeros((1, dim))
    assigned = rows.withColumn("cell", F.get(nearest_cells(F.col("v"), centres, 1), F.lit(0)))
    # by range of (cell, id): a large cell is many files, small cells share a task
    assigned.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(f"{path}/assigned")
    stored = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/assigned")
    subs = stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n_subs"))
    subs.write.parquet(f"{path}/subs")                               # a row per cell
    return CellIndex(f"{path}/assigned", centres, spark.read.schema("cell int, n_subs int").parquet(f"{path}/subs"))


def _lists(spark: SparkSession, index: CellIndex) -> DataFrame:
    rows = spark.read.schema("id long, v array<double>, cell int").parquet(index.path)
    return rows.join(F.broadcast(index.subs), "cell").withColumn(      # at most MAX_CELLS rows
        "sub", F.pmod(F.xxhash64("id"), F.col("n_subs")).cast("int")).drop("n_subs")


def search_cells(queries: DataFrame, index: CellIndex, nprobe: int, k: int = C.TOP_K, floor: float | None = C.FLOOR,
                 query_key: str = "query_id", query_vec: str = "vector", decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank) among the vectors of each query's `nprobe` nearest
    cells; scores, ties and floor as in the exact search."""
    spark = queries.sparkSession
    centres, dim = index.centres, index.centres.shape[1]
    asked = _keyed(queries, query_key, query_vec).withColumnRenamed("id", "query_id")
    probes = asked.select("query_id", "v", F.explode(nearest_cells(F.col("v"), centres, min(nprobe, len(centres)))).alias("cell"))
    # the queries of a cell in slices; a list is read once per slice
    slices = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("n_slices"))
    units = F.broadcast(slices.join(index.subs, "cell"))             # at most MAX_CELLS rows
    sent = probes.join(units, "cell").select(
        "query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), F.col("n_slices")).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("n_subs") - 1)).alias("sub"))
    lists = _lists(spark, index).join(F.broadcast(slices), "cell").select(
        "id", "v", "cell", "sub", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"))

    def score(lists: pa.Table, asked: pa.Table) -> pa.Table:
        if not lists.num_rows or not asked.num_rows:
            query, ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
            of_query = query
        else:
            Q = _rows(asked.column("v").combine_chunks(), dim)
            M = _rows(lists.column("v").combine_chunks(), dim)
            query, ids, scores = score_blocks(Q, [(lists.column("id").to_numpy(), M)], k, decimals)
            of_query = asked.column("query_id").to_numpy()
        return pa.table({"query_id": pa.array(of_query[query], pa.int64()), "id": pa.array(ids, pa.int64()), "score": scores})

    key = ["cell", "sub", "slice"]
    parts = lists.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(score, "query_id long, id long, score double")
    return rank_hits(parts, k, floor)


def choose_nprobe(queries: DataFrame, corpus: DataFrame, index: CellIndex, target: float = 0.95, k: int = C.TOP_K,
                  floor: float | None = C.FLOOR, query_key: str = "query_id", query_vec: str = "vector",
                  key: str = "id", vec: str = "vector") -> int:
    """The least number of cells that finds `target` of the exact neighbours of a
    bounded sample of queries (SAMPLE_QUERIES rows of smallest id hash)."""
    dim = index.centres.shape[1]
    some = queries.orderBy(F.xxhash64(query_key), query_key).limit(SAMPLE_QUERIES).select(
        F.col(query_key).alias("query_id"), F.col(query_vec).alias("vector")).checkpoint()
    exact = search_topk(some, corpus, k, floor, key=key, vec=vec, dim=dim)
    homes = queries.sparkSession.read.schema("id long, v array<double>, cell int").parquet(index.path).select("id", "cell")
    order = _keyed(some, "query_id", "vector").select(
        F.col("id").alias("query_id"), nearest_cells(F.col("v"), index.centres, len(index.centres)).alias("cells"))
    place = (F.broadcast(exact).join(homes, "id").join(F.broadcast(order), "query_id")     # at most SAMPLE_QUERIES x k rows
             .select(F.array_position("cells", F.col("cell")).cast("int").alias("place")))
    counts = place.groupBy("place").count().orderBy("place").collect()                    # at most MAX_CELLS rows
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= target * total:
            return int(r["place"])
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query of the exact hits: n_exact, n_found, recall."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return (exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
            .withColumn("recall", F.col("n_found") / F.col("n_exact")))

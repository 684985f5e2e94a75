"""Point tables over time: idempotent upsert, key-based resume, sinks.

The upsert of two frames; `versioned.Collection` keeps its result on files.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _last_first(rows: DataFrame, order: str | None) -> list[Column]:
    """Sort columns that put the row which counts before the others of its key."""
    everything = [x for c in rows.columns for x in (F.col(c).isNull(), F.col(c))]
    return ([F.col(order).desc()] if order else []) + [F.xxhash64(*everything).desc(), F.hash(*everything).desc()]


def last_by_key(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the one with the largest `order`, and among equals (or
    without an order) the one of largest row hash, so the choice does not depend on
    partitioning.  Only keys, orders and hashes are compared, never whole rows; the
    cut to one row is made before the shuffle too (a group limit), so a hot key sends
    one row per task."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*_last_first(rows, order))))
    return ranked.where("_nth = 1").drop("_nth")


def begins_run(keys: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether each key differs from the one before it, of which the first's comes in an array of
    one (None: there is none).  Nulls are equal."""
    earlier = pa.concat_arrays([before if before is not None else keys[:1], keys[:-1]])
    same = pc.fill_null(pc.equal(keys, earlier), False).to_numpy(zero_copy_only=False)
    same = same | (keys.is_null().to_numpy(zero_copy_only=False) & earlier.is_null().to_numpy(zero_copy_only=False))
    if before is None:
        same[:1] = False
    return ~same


def last_by_key_in_place(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """`last_by_key` of rows whose equal keys are in one partition, with no exchange: the
    partition is sorted, and of every run of a key its first row stays.  Keys are strings or integers."""
    def first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(key)
                yield batch.filter(pa.array(begins_run(keys, before)))
                before = keys[-1:]
    return rows.sortWithinPartitions(key, *_last_first(rows, order)).mapInArrow(first_of_runs, rows.schema)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", order: str | None = None,
           unique: bool = False) -> DataFrame:
    """Insert-or-replace by key: the incoming row wins, and of several incoming
    rows with one key the last by `order` (`unique`: there is only one).  The anti
    join reads only the incoming keys, so AQE can broadcast them when the batch is small."""
    last = incoming if unique else last_by_key(incoming, key, order)
    keep = existing.join(last.select(key), key, "left_anti")
    return keep.unionByName(last.select(*existing.columns))


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows not yet processed, by key (not by a count of rows done)."""
    return chunks.join(done.select(key), key, "left_anti")


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _complete(spark: SparkSession, path: str) -> bool:
    """A written table, not the remains of a write that failed."""
    return _fs_exists(spark, path.rstrip("/") + "/_SUCCESS")


def materialize_once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write `df` to `path` unless a complete copy is there already, then read
    the copy back (fetch once, then always load the saved copy).  The remains of
    a failed write are written again."""
    if not _complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """Name of a table's present state: names, sizes and times of its files, without reading them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24]


def fingerprint(df: DataFrame) -> str:
    """Order-independent fingerprint of a table's content: row count and the
    sum of 64-bit row hashes (one distributed aggregate).  Nulls are hashed as
    such: (null, 'a') and ('a', null) differ."""
    cells = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("h")).first()
    return f"{int(r['n']):x}-{int(r['h'] or 0) & ((1 << 64) - 1):016x}"


def chunk_sink(spark: SparkSession, corpus: DataFrame, make_chunks, base: str) -> DataFrame:
    """Chunk table cached on disk under a fingerprint of its input: a changed
    corpus gets a new folder instead of silently reusing stale chunks."""
    return materialize_once(spark, make_chunks(corpus), f"{base.rstrip('/')}/chunks-{fingerprint(corpus)}")


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder per split (split=train, split=eval)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)

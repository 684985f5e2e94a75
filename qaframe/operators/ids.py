"""Dense positions over a global order, without a global window.

A window with an ORDER BY but no PARTITION BY moves every row to one task.
Instead: cut the key range into buckets, count rows per bucket (partial
aggregation, a tiny shuffle), take running offsets on that small table, and
rank rows inside their bucket.  Only the bucket-count table is broadcast, and
only after its row count has been checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _offsets(df: DataFrame, bucket: str) -> DataFrame:
    """Per-bucket row count and the number of rows in all earlier buckets."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_cnt"))
    # running sum on the small per-bucket table (one row per bucket)
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(bucket, "_cnt", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_offset"))


def dense_positions(df: DataFrame, bucket: Column, order: list[Column], name: str = "pos") -> DataFrame:
    """Add `name` = 0-based position of each row in the global order
    (bucket, *order).  `bucket` must be monotone in the order (e.g. key div B).

    Rows are shuffled once, by bucket, for the in-bucket rank; the offset
    table joins on the same key.  It is not hinted for broadcast: its size
    grows with the key range, so AQE decides at run time from its measured
    size (spark.sql.adaptive.autoBroadcastJoinThreshold) and otherwise joins
    it on the existing bucket partitioning.

    The input is read twice (counts, then rows): pass a materialised table
    when it is expensive to compute."""
    b = df.withColumn("_bucket", bucket)
    offsets = _offsets(b, "_bucket").select("_bucket", "_offset")
    w = Window.partitionBy("_bucket").orderBy(*order)
    ranked = b.withColumn("_rn", F.row_number().over(w))
    return (ranked.join(offsets, "_bucket")
            .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
            .drop("_bucket", "_offset", "_rn"))


def id_bucket(key: str, bucket_rows: int = 8192) -> Column:
    """Bucket of consecutive integer keys: key div bucket_rows."""
    return F.floor(F.col(key) / F.lit(bucket_rows)).cast("long")


def prefix_starts(df: DataFrame, order: list[str], weight: str, name: str = "start") -> DataFrame:
    """Add `name` = sum of `weight` over all rows before this one in `order`.

    For narrow rows.  They are range-partitioned by the order itself, so the
    partitions are even however the keys are spaced; partition totals (one small
    row each) give the offsets, a running sum inside the partition the rest.  The
    ranges are checkpointed, so partition numbers hold for both reads."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.checkpoint().repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id()).checkpoint())
    totals = ranged.groupBy("_part").agg(F.sum(weight).alias("_w"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(F.broadcast(offsets), "_part")          # one row per partition
            .withColumn(name, F.col("_offset") + F.sum(weight).over(inside) - F.col(weight))
            .drop("_part", "_offset"))


def hash_bucket(hex_col: str, digits: int = 4) -> Column:
    """Bucket from the leading hex digits of a uniform hash (16**digits buckets,
    so the offset table has a fixed upper size)."""
    return F.conv(F.substring(F.col(hex_col), 1, digits), 16, 10).cast("long")


def first_n_by_rank(df: DataFrame, hex_col: str, tie: str, n_first: int, label_first: str,
                    label_rest: str, name: str, digits: int = 4) -> DataFrame:
    """Label the first `n_first` rows of the order (hex_col, tie) with
    `label_first`, the others with `label_rest`.

    Whole buckets before or after the boundary are decided from the broadcast
    offset table alone (no shuffle of their rows); only rows of the single
    bucket that straddles the boundary are ranked by a window.
    """
    b = df.withColumn("_bucket", hash_bucket(hex_col, digits))
    offsets = _offsets(b, "_bucket")  # at most 16**digits rows: bounded by construction
    j = b.join(F.broadcast(offsets), "_bucket")
    decided = j.filter((F.col("_offset") + F.col("_cnt") <= n_first) | (F.col("_offset") >= n_first))
    decided = decided.withColumn(name, F.when(F.col("_offset") < n_first, F.lit(label_first))
                                 .otherwise(F.lit(label_rest)))
    edge = j.filter((F.col("_offset") < n_first) & (F.col("_offset") + F.col("_cnt") > n_first))
    w = Window.partitionBy("_bucket").orderBy(F.col(hex_col), F.col(tie))
    edge = edge.withColumn(name, F.when(F.col("_offset") + F.row_number().over(w) <= n_first,
                                        F.lit(label_first)).otherwise(F.lit(label_rest)))
    return decided.unionByName(edge).drop("_bucket", "_offset", "_cnt")

"""Contiguous balanced shards from global byte-size prefix sums (operator 5),
DataFrame operations only.

The rows (id, size, checksum - never the texts) are range-partitioned and
sorted by id and written once, so that partition numbers hold for both passes.
The per-partition totals of bytes and rows, one small row per partition, give
every partition its offset; inside a partition a running sum makes the global
prefix sum.  A row goes to the shard in whose equal share of all bytes its
middle byte lies.

Law: `bytes`.  A shard differs from the equal share by less than the size of
the two rows at its ends.

Defined results: a null or empty text has size `overhead`; rows are ordered by
id (nulls first), then size, then checksum, so ties and repeated rows are dealt
in a fixed order and a hot id is spread over partitions as far as its sizes
and checksums differ.  Texts are measured whole, however long.  An empty table
gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaframe.llm.common import shuffle_width, stage, workdir


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + overhead).cast("bigint").alias("size"),
                       F.crc32(body).alias("crc"))
    # checksums are computed once, before the sampling pass of the range exchange
    rows = stage(rows, workdir(spark, "shard-rows"))
    order = ["id", "size", "crc"]
    ranged = (rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id()))
    ranged = stage(ranged, workdir(spark, "shard-ranges"))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # one row per partition: the only place without a partition key
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        *order, "total",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("rank"))
    # the shard of the middle byte; decimal, since bytes times shards can pass 64 bits
    middle = (2 * F.col("start") + F.col("size")).cast("decimal(24,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total"))).cast("int"))
    placed = stage(placed.select(*order, "rank", shard.alias("shard")), workdir(spark, "shard-placed"))
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))   # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"))

"""Incremental index build on a stream.

New corpus rows are chunked, embedded and upserted into the collection in every
micro-batch (`foreachBatch`).  Points are keyed by (sample_id, chunk_pos), which does
not depend on what else is in the batch.  A batch commits its rows and its number
together, as one version of the collection: a batch that runs again after a failure
changes nothing, and a stream that was stopped goes on from its checkpoint.

A sample's points lie in the bucket of its id.  The corpus is dealt by the id, so its texts
are all that is exchanged, and points are written by the tasks that make them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, vectors
from .. import constants as C
from ..sources.corpus import spread_wide
from ..sources.versioned import Collection

KEY = ["sample_id", "chunk_pos"]
PLACE = "sample_id"
# files of a batch's exchanges go with its last read, not when the driver collects its garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def index_batch(corpus_vi: DataFrame) -> DataFrame:
    """corpus (sample_id, query, response, math_type) -> points with payload."""
    c = chunking.chunk_samples(corpus_vi)
    return vectors.hash_embed(c, "text", "vector")


def points_of(corpus_vi: DataFrame) -> DataFrame:
    """The points of a corpus with their key."""
    return index_batch(corpus_vi).withColumn("point_key", F.concat_ws(":", *[F.col(k).cast("string") for k in KEY]))


def run_index_stream(spark: SparkSession, stream: DataFrame, table_path: str, checkpoint: str, to_corpus,
                     n_buckets: int = 64, name: str = "index", on_batch=None, keep: int | None = None) -> Collection:
    """Run the stream over what has arrived; returns the collection.

    `name` tells streams into one collection apart.  `on_batch` is called with each
    batch's number and "before" or "after" its commit.  With `keep` only the last versions stay
    after a batch, and their files: nobody else may be writing, or reading older ones."""
    schema = points_of(to_corpus(spark.createDataFrame([], stream.schema))).schema
    table = Collection.ensure(spark, table_path, schema, "point_key", n_buckets, PLACE, vector="vector", dim=C.HASH_DIM)

    def write(batch: DataFrame, epoch: int) -> None:
        if on_batch:
            on_batch(epoch, "before")
        own = batch.sparkSession                         # the stream's
        own.conf.set(SHUFFLE_CLEANUP, "true")
        stored = Collection(own, table_path)
        dealt = spread_wide(to_corpus(batch), PLACE, n_buckets)
        stored.upsert(points_of(dealt), stream=name, epoch=epoch)
        if keep:
            stored.vacuum(keep)
        if on_batch:
            on_batch(epoch, "after")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table

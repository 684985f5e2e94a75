"""Line deduplication over levelled sorted runs of line hashes (operator 6),
DataFrame operations only.

A run is a Parquet table sorted by line hash: (h1, h2, n_docs, max_doc, fresh).  It is
stored in one sorted file per hash bucket, with one bucket count for all runs, and
Spark knows it: merge joins of a batch with the runs, and of runs with each other,
read the files as they are, without shuffling or sorting an earlier run again.
`LineRuns` keeps runs in levels like a log-structured merge tree.  A new batch
of documents is reduced to its distinct line hashes first (partial aggregation
before the shuffle, so a line held by a third of the documents moves one row
per task), merge-anti-joined with the runs to find the hashes not seen before,
and added as a run of level 0.  When a level holds `fanout` runs they are
merged into one run of the next level, so a hash is rewritten O(log batches)
times.

A hash is the pair of two 64-bit hashes with different seeds of the key: 128
bits identify a line.

Defined results: a null or empty text is one empty line.  Lines whose key is
shorter than `min_chars` always stay.  Every row counts as a document of its
own, so repeated rows count as often as they occur, and rows that share the
largest id all keep their lines.  A null id is smaller than any other id.  Lines are
hashed whole, however long.  An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaframe.llm.common import WS_CHARS, ascii_lower, shuffle_width, stage, workdir

NULL_ID = -(1 << 63)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(d, th, h1, h2, pos, first) of every line that is long enough.  Narrow.

    `th` tells rows of one id apart by their texts; `first` marks one line per
    row and key, so that its sum counts rows."""
    keyed = F.transform(F.split("t", "\n"), lambda x, i: F.struct(_key(x).alias("k"), i.alias("pos")))
    hashed = F.transform(F.filter(keyed, lambda e: F.length(e["k"]) >= min_chars), lambda e: F.struct(
        F.xxhash64(e["k"]).alias("h1"), F.xxhash64(F.lit("line"), e["k"]).alias("h2"), e["pos"].alias("pos")))
    none = F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint,pos:int>"))
    marked = F.zip_with("hs", F.slice(F.concat(none, F.col("hs")), F.lit(1), F.size("hs")), lambda a, b: F.struct(
        a["h1"].alias("h1"), a["h2"].alias("h2"), a["pos"].alias("pos"),
        F.coalesce((a["h1"] != b["h1"]) | (a["h2"] != b["h2"]), F.lit(True)).alias("first")))
    return (docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("d"), _text(text_col).alias("t"))
            .select("d", F.xxhash64("t").alias("th"), F.array_sort(hashed).alias("hs"))
            .select("d", "th", F.explode(marked).alias("h")).select("d", "th", "h.*"))


# lets a scan of one sorted file per bucket count as sorted
ORDERED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED_SCANS, None)
    spark.conf.set(ORDERED_SCANS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ORDERED_SCANS)
        else:
            spark.conf.set(ORDERED_SCANS, before)


class LineRuns:
    """Levelled sorted runs of line hashes in a shared folder.

    Their tables are external ones of the session's catalog; `forget` drops the
    entries and leaves the files."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = shuffle_width(spark)
        self.levels: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []

    def _store(self, rows: DataFrame) -> DataFrame:
        """Write rows in one sorted file per hash bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2")
         .sortBy("h1", "h2").option("path", f"{self.path}/run-{len(self.tables):05d}").saveAsTable(name))
        self.tables.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _keys(run: DataFrame) -> DataFrame:
        """The hashes that a run brought in; a hash is fresh in one run only, so the
        runs' rows of this kind are the whole key set, without repetition."""
        return run.where("fresh").select("h1", "h2").hint("merge")

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a stored batch whose hash no run holds: merge anti joins, one after another."""
        for run in self.runs():
            batch = batch.join(self._keys(run), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of line hashes; the returned run marks with `fresh` the
        hashes that no earlier run holds."""
        own = batch.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("d").alias("max_doc"))
        if not self.runs():
            run = self._store(own.withColumn("fresh", F.lit(True)))
        else:
            own = self._store(own)
            with ordered_scans(self.spark):
                new = self.unseen(own).withColumn("fresh", F.lit(True))
                for earlier in self.runs():
                    seen = own.join(self._keys(earlier), ["h1", "h2"], "left_semi")
                    new = new.unionByName(seen.withColumn("fresh", F.lit(False)))
                run = self._store(new)
        self.levels[0].append(run)
        self._compact()
        return run

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several, by full merge joins: of the first two as their files are, then
        of the result, which is dealt by hash again, with the next."""
        out = runs[0]
        for i, run in enumerate(runs[1:]):
            other = run.select("h1", "h2", F.col("n_docs").alias("n2"), F.col("max_doc").alias("m2"), F.col("fresh").alias("f2"))
            out = out.join(other.hint("merge"), ["h1", "h2"], "full").select(
                "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"),
                F.greatest("max_doc", "m2").alias("max_doc"),
                (F.coalesce("fresh", F.lit(False)) | F.coalesce("f2", F.lit(False))).alias("fresh"))
        return out

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                with ordered_scans(self.spark):
                    self.levels[k + 1].append(self._store(self._merged(self.levels[k])))
                self.levels[k] = []
            k += 1

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) over all runs: the row that brought a hash in
        as new, brought forward by the rows of later batches that saw it again."""
        rows = self._union(self.runs())
        later = rows.where(~F.col("fresh")).groupBy("h1", "h2").agg(
            F.sum("n_docs").alias("more"), F.max("max_doc").alias("later_doc"))
        return rows.where("fresh").join(later, ["h1", "h2"], "left").select(
            "h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.greatest("max_doc", "later_doc").alias("max_doc"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
               min_docs: int = 3, batches: int = 4, fanout: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Lines found in `min_docs` documents or more stay only in the largest id.

    Returns per input row: id, n_lines, n_dropped, kept_text, and the columns
    of `carry` in a struct `carried`.  The documents
    are ingested into the runs in `batches` batches by a hash of the id, so a
    document belongs to one batch and the counts of the runs add up.
    """
    spark = docs.sparkSession
    path = workdir(spark, "line-runs")
    hashes = line_hashes(docs, id_col, text_col, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64("d"), F.lit(batches)).cast("int"))
    hashes.write.partitionBy("batch").parquet(f"{path}/lines")
    hashes = spark.read.schema(hashes.schema).parquet(f"{path}/lines")
    runs = LineRuns(spark, f"{path}/runs", fanout)
    for b in range(batches):
        runs.add(hashes.where(F.col("batch") == b))
    listed = stage(runs.totals().where(F.col("n_docs") >= min_docs), f"{path}/listed")
    runs.forget()
    # positions of the lines to drop; a common line is split by the skew join
    drops = (hashes.join(listed, ["h1", "h2"]).where("d <> max_doc")
             .groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("d"),
                       F.struct(*carry).alias("carried") if carry else F.struct(F.lit(None)).alias("carried"),
                       _text(text_col).alias("t")).withColumn("th", F.xxhash64("t"))
    lines = rows.join(drops, ["d", "th"], "left").select("id", "carried", "t", "gone", F.split("t", "\n").alias("lines"))
    # what stays are the slices between the dropped positions: linear in the text
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    return lines.select(
        F.col("id").alias(id_col), *(["carried"] if carry else []), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))

"""The training-data pipeline: each stage runs one operator over everything
its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that `run` writes
as Parquet and rereads as the next stage's docs.  All stages but the last return
the columns of `documents`, in their order; `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaframe.llm.common import release, stage, table, workdir
from qaframe.llm.line_dedup import line_dedup
from qaframe.llm.minhash import BROADCAST_IDS, near_duplicates
from qaframe.llm.packing import pack
from qaframe.llm.quality import quality
from qaframe.llm.queries import tokenizer


def _with_text(docs: DataFrame, rows: DataFrame, text: str, row: str) -> DataFrame:
    """The columns of docs out of the struct `row`, with another text."""
    def column(name: str) -> Column:
        if name == "text":
            return F.col(text).alias("text")
        if name == "n_chars":
            return F.length(text).cast("bigint").alias("n_chars")
        return F.col(f"{row}.`{name}`").alias(name)
    return rows.select(*[column(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose their failing lines.

    A null or empty text, with fewer than 50 words, goes; a null id does not matter.
    Repeated rows are judged one by one, long texts whole.  No rows give no rows; other
    columns pass as they are, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    judged = quality(docs.select(F.struct(*rest).alias("row"), "text"), id_col="row").where("kept")
    return _with_text(docs, judged, "cleaned", "row")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the largest id only.

    A null text becomes the empty one.  Rows that share the largest id all keep the
    line; a null id is smaller than any other; repeated rows count one by one.  No rows
    give no rows; other columns pass as they are, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    return _with_text(docs, line_dedup(docs, carry=rest), "kept_text", "carried")


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id.  Of rows that
    share this id one stays, that whose text has the smallest hash; rows without an id
    belong to no group and stay.  Texts are compared whole; a null or empty text is
    linked with nothing and stays.  No rows give no rows; other columns pass as they are."""
    found = stage(near_duplicates(docs, words=5), workdir(spark, "pipeline-near"))
    losers = found.where(~F.col("kept")).select("doc_id").distinct()
    if losers.count() <= BROADCAST_IDS:
        losers = F.broadcast(losers)
    kept = docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n_twice = twice.count()
    if not n_twice:
        return kept
    if n_twice <= BROADCAST_IDS:
        twice = F.broadcast(twice)
    # the row is chosen by its content, so a task that runs again chooses the same
    rest = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    by = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", F.xxhash64(*rest))
    nth = "nth"
    while nth in docs.columns:
        nth += "_"
    several = kept.join(twice, "doc_id", "left_semi").withColumn(nth, F.row_number().over(by)).where(F.col(nth) == 1)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its ids.

    A null or empty text is one end-of-document id; a null id is packed under a null
    id, repeated rows once per row, long texts whole.  No rows give no rows."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", repeated_lines),
          ("minhash_near_dedup", near_duplicate_documents), ("packing", packing)]

# ids by a tokenizer file have no SQL form; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = workdir(spark, "pipeline")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"{path}/{name}")
        release(spark, keep=path)        # what the stage's operators wrote has been read
    return docs

"""Corpus sources: parquet tables, the Q/A corpus adapter, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import TEXT_PARTITIONS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal the rows of a text table to `spark.qaframe.textPartitions`
    partitions, if the caller's session says so.

    A Parquet row group is read by one task, whatever the byte-range splits say:
    a table written as one row group is one task of text work.  Only the caller
    knows how the input was written, so the scan's own splits are the default."""
    n = int(df.sparkSession.conf.get(TEXT_PARTITIONS, "0"))
    if n <= 0:
        return df
    return df.repartition(n, key) if key else df.repartition(n)


def spread_wide(df: DataFrame, key: str, multiple: int = 1) -> DataFrame:
    """`spread`, and over the cluster's cores where the session says nothing: for work that
    costs many times a shuffle of its texts, whatever row groups these were written in.
    The number of partitions is then a multiple of `multiple`."""
    spark = df.sparkSession
    if int(spark.conf.get(TEXT_PARTITIONS, "0")) > 0:
        return spread(df, key)
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(-(-n // multiple) * multiple, key)


def read_text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows carry long texts (documents, pages, conversations)."""
    return spread(read_table(spark, sf_dir, name), key)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Scan a saved corpus (parquet with the corpus schema); no inference."""
    return spark.read.schema(S.CORPUS).parquet(path)


def stream_table(spark: SparkSession, folder: str, files: str, schema, per_trigger: int | None = 1) -> DataFrame:
    """The files of a folder that match a name or pattern as a stream, one file a trigger
    (None: all that are there).

    A table may be one file or a folder of files: the name stands in the path, not in
    `pathGlobFilter`, which tests the names of the files inside.  In braces a plain name is a
    pattern too; the file source takes a path without a pattern for a folder."""
    name = files if any(c in files for c in "*?[{") else "{" + files + "}"
    stream = spark.readStream.schema(schema)
    if per_trigger:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    return stream.parquet(f"{folder.rstrip('/')}/{name}")


def qa_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_from_documents(read_text_table(spark, sf_dir, "documents", "doc_id"))


def qa_from_documents(documents: DataFrame) -> DataFrame:
    """The `qa` adapter over `documents` (batch or stream): first line = question, the rest =
    answer, with absent values, CRLF runs, double spaces and step markers
    planted by a rule on the id so that every operator path is exercised.
    All rows are kept; the id rule only chooses which variant a row gets."""
    d = documents.select("doc_id", "text", "source")
    nl = F.lit("\n")
    has_nl = F.instr("text", "\n") > 0
    b = d.select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("math_type"),
        F.split_part("text", nl, F.lit(1)).alias("q0"),
        F.when(has_nl, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("r0"),
    )
    sid = F.col("sample_id")
    query = (F.when(sid % 13 == 0, F.lit(""))
             .when(sid % 17 == 0, F.lit(None).cast("string"))
             .when(sid % 5 == 0, F.concat("q0", F.lit("  $a   b$   $$c   d$$  end")))
             .otherwise(F.col("q0")))
    response = (F.when(sid % 19 == 0, F.lit(None).cast("string"))
                .when(sid % 11 == 0, F.replace("r0", nl, F.lit("\r\n\r\n\r\n")))
                .when(sid % 7 == 0, F.replace("r0", F.lit(". "), F.lit(".  ")))
                .when(sid % 2 == 0, F.replace("r0", nl, F.lit("\nVậy ")))
                .when(sid % 3 == 0, F.concat(F.lit("Bước 1: "), F.replace("r0", nl, F.lit("\n2. "))))
                .otherwise(F.col("r0")))
    return b.select(
        sid,
        F.col("q0").alias("original_question_vi"),
        query.alias("query_vi"),
        response.alias("response_vi"),
        F.col("q0").alias("original_question_en"),
        F.col("q0").alias("query_en"),
        F.col("r0").alias("response_en"),
        F.col("math_type").alias("type"),
    )


def project_lang(corpus: DataFrame, lang: str = "vi") -> DataFrame:
    """`get_item_vi` / `get_item_en` for every row: one language's columns
    under neutral names."""
    if lang not in ("vi", "en"):
        raise ValueError(f"unknown language {lang!r}")
    return corpus.select(
        "sample_id",
        F.col(f"original_question_{lang}").alias("original_question"),
        F.col(f"query_{lang}").alias("query"),
        F.col(f"response_{lang}").alias("response"),
        F.col("type").alias("math_type"),
    )


def slice_rows(df: DataFrame, start: int = 0, n: int = 3, key: str = "sample_id") -> DataFrame:
    """Rows at positions [start, start + n) by an explicit key (a range
    filter, pushed to the parquet scan), never "the n-th row" of a shuffle."""
    return df.filter(F.col(key).between(start, start + n - 1))

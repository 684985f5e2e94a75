"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaframe.session import ensure_checkpoint_dir, ship_package

# code points that separate words and are stripped from line ends
WS = "\\x20\\x09-\\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OPENED: list[str] = []


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder.  It stays until `release`:
    the frame that an operator returns reads from it."""
    ship_package(spark)
    _OPENED.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _OPENED[-1]


def release(spark: SparkSession, keep: str | None = None) -> None:
    """Remove the folders that `workdir` gave out so far, but `keep`: once the results
    of the operators have been written elsewhere, nothing reads them any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in [f for f in _OPENED if f != keep]:
        p = hadoop(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _OPENED.remove(folder)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as a table and read it back: cuts the lineage, and a lost
    executor costs no recomputation beyond the reading stage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

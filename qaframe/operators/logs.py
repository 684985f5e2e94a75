"""Training-log report: JSONL lines -> rounded metrics, log lines, best step.

A line is a JSON object: `step` and `epoch`, then whatever a step reports
(`loss`, `eval_loss`, `learning_rate`, any other metric), then `timestamp`.  Keys are
dynamic: an entry holds its metrics as a map, a metric without a value is no key,
and of equal keys the later wins.  Lines are read back as VARIANT, so no schema limits
their keys, and files from many runs or writers are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def log_lines(entries: DataFrame) -> DataFrame:
    """JSON lines of entries (step, epoch, metrics: map of doubles, timestamp).

    The metrics come after step and epoch, the timestamp last: a metric named like
    one that stands before it replaces its value."""
    first = F.expr("map('step', cast(step as variant), 'epoch', cast(epoch as variant))")
    last = F.expr("map_filter(map('timestamp', cast(timestamp as variant)), (k, v) -> timestamp is not null)")
    metrics = F.transform_values(F.map_filter("metrics", lambda k, v: v.isNotNull() & (k != "timestamp")),
                                 lambda k, v: v.cast("variant"))
    own = F.map_filter(first, lambda k, v: ~F.coalesce(F.map_contains_key(metrics, k), F.lit(False)))
    return entries.select(F.to_json(F.map_concat(own, metrics, last)).alias("value"))


def append_log(entries: DataFrame, path: str) -> None:
    """Append the entries' lines to the log at `path`."""
    log_lines(entries).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line: variant) of the log; a broken line is null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("line"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The known keys of every whole line as columns; a missing key is null."""
    lines = read_lines(spark, path).where("line is not null")
    return lines.select(*[F.try_variant_get("line", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
                          for f in S.TRAINING_LOG.fields])


def log_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, n_lines): every key that lines of the log have."""
    lines = read_lines(spark, path).where("line is not null")
    keys = lines.select(F.explode(F.map_keys(F.from_json(F.to_json("line"), "map<string,string>"))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"))


def _num(c: str):
    """A rounded metric as plain decimal text: `2.0`, `0.1234`, `0.0002`, never
    an exponent, and at least one digit after the point."""
    text = F.regexp_replace(F.col(c).cast("decimal(30,4)").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def log_report(log: DataFrame) -> DataFrame:
    """Per line: metrics rounded to 4 places (learning rate also raw, since
    rounding loses small rates) and the console line
    `step=     5 | epoch=0.1 | loss=... | eval_loss=... | lr=...` where
    missing metrics are left out."""
    r = log.select(
        "step", F.round("epoch", 3).alias("epoch"),
        F.round("loss", 4).alias("loss"), F.round("eval_loss", 4).alias("eval_loss"),
        F.round("learning_rate", 4).alias("learning_rate"), F.col("learning_rate").alias("learning_rate_raw"),
        "timestamp")
    msg = F.concat_ws(" | ",
                      F.concat(F.lit("step="), F.format_string("%6d", F.col("step"))),
                      F.concat(F.lit("epoch="), _num("epoch")),
                      F.when(F.col("loss").isNotNull(), F.concat(F.lit("loss="), _num("loss"))),
                      F.when(F.col("eval_loss").isNotNull(), F.concat(F.lit("eval_loss="), _num("eval_loss"))),
                      F.when(F.col("learning_rate").isNotNull(), F.concat(F.lit("lr="), _num("learning_rate"))))
    return r.withColumn("message", msg)


def best_checkpoint(log: DataFrame) -> DataFrame:
    """Step with the lowest eval_loss (0.0 is a real value); ties go to the
    earlier step.  One row, empty when no line has eval_loss."""
    e = log.filter(F.col("eval_loss").isNotNull())
    return e.agg(F.min_by("step", F.struct("eval_loss", "step")).alias("best_step"),
                 F.min("eval_loss").alias("best_eval_loss")).filter(F.col("best_step").isNotNull())

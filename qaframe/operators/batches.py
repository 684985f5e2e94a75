"""Exact seeded split, head limits and padded batches.

The shuffle order is md5(seed ':' id): reproducible, independent of
partitioning, and uniform, so hash-prefix buckets are balanced.  Positions
come from per-bucket offsets (ids.py); only buckets that straddle a cut are
ranked row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from . import ids as I


def with_shuffle_key(df: DataFrame, key: str = "sample_id", seed: int = C.SPLIT_SEED) -> DataFrame:
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def _once(df: DataFrame) -> DataFrame:
    """Narrow rows (a key and a few numbers) are written once: the count, the bucket
    offsets and the ranks read them again without repeating the work behind them."""
    return df.checkpoint(eager=True)


def eval_size(n: int, fraction: float = C.EVAL_FRACTION) -> int:
    return int(math.ceil(fraction * n))


def train_eval_split(df: DataFrame, key: str = "sample_id", fraction: float = C.EVAL_FRACTION,
                     seed: int = C.SPLIT_SEED, digits: int = 4) -> DataFrame:
    """Exact split: the first ceil(fraction * n) rows of the seeded order are
    'eval', the rest 'train'.  Adds column `split`."""
    df = _once(df)
    n = df.count()
    h = with_shuffle_key(df, key, seed)
    out = I.first_n_by_rank(h, "_h", key, eval_size(n, fraction), "eval", "train", "split", digits)
    return out.drop("_h")


def rank_range(df: DataFrame, hex_col: str, tie: str, lo: int, hi: int, name: str = "rank",
               digits: int = 4) -> DataFrame:
    """Rows whose 0-based position in the order (hex_col, tie) lies in
    [lo, hi), with that position.  Buckets wholly outside the range are
    dropped from the broadcast offset table before any row is shuffled."""
    b = df.withColumn("_bucket", I.hash_bucket(hex_col, digits))
    offsets = I._offsets(b, "_bucket")
    offsets = offsets.filter((F.col("_offset") < hi) & (F.col("_offset") + F.col("_cnt") > lo))
    j = b.join(F.broadcast(offsets), "_bucket")   # <= 16**digits rows
    w = Window.partitionBy("_bucket").orderBy(F.col(hex_col), F.col(tie))
    r = j.withColumn(name, F.col("_offset") + F.row_number().over(w) - 1)
    return r.filter((F.col(name) >= lo) & (F.col(name) < hi)).drop("_bucket", "_offset", "_cnt")


def limited_splits(df: DataFrame, max_samples: int | None, key: str = "sample_id",
                   fraction: float = C.EVAL_FRACTION, seed: int = C.SPLIT_SEED, digits: int = 4) -> DataFrame:
    """Head limits of the split: train keeps its first min(max_samples, |train|)
    rows, eval its first max(1, n // 20) rows (never more than it has).
    0 or None means no limit.  Adds `split` and `pos` (position in the split)."""
    df = _once(df)
    n = df.count()
    n_eval = eval_size(n, fraction)
    n_train = n - n_eval
    if max_samples:
        t = min(max_samples, n_train)
        e = min(max(1, t // 20), n_eval)
    else:
        t, e = n_train, n_eval
    h = with_shuffle_key(df, key, seed)
    ev = rank_range(h, "_h", key, 0, e, "_g", digits).withColumn("split", F.lit("eval")) \
        .withColumn("pos", F.col("_g"))
    tr = rank_range(h, "_h", key, n_eval, n_eval + t, "_g", digits).withColumn("split", F.lit("train")) \
        .withColumn("pos", F.col("_g") - n_eval)
    return ev.unionByName(tr).drop("_g", "_h")


def train_positions(df: DataFrame, key: str = "sample_id", fraction: float = C.EVAL_FRACTION,
                    seed: int = C.SPLIT_SEED, digits: int = 4) -> DataFrame:
    """Train rows with their position in the train split."""
    df = _once(df)
    n = df.count()
    n_eval = eval_size(n, fraction)
    h = with_shuffle_key(df, key, seed)
    r = rank_range(h, "_h", key, n_eval, n, "_g", digits)
    return r.withColumn("pos", F.col("_g") - n_eval).drop("_g", "_h")


def padded_lengths(rows: DataFrame, length: str, pos: str = "pos", batch_size: int = C.TRAIN_BATCH,
                   multiple: int = C.PAD_MULTIPLE) -> DataFrame:
    """batch_id = pos div batch_size; every row of a batch is padded to the
    batch's longest row rounded up to a multiple of `multiple`."""
    b = rows.withColumn("batch_id", F.floor(F.col(pos) / batch_size).cast("long"))
    w = Window.partitionBy("batch_id")
    mx = F.max(length).over(w)
    return b.withColumn("padded_len", (F.ceil(mx / multiple) * multiple).cast("long")) \
        .withColumn("n_pad", F.col("padded_len") - F.col(length))


def pad_arrays(ids, labels, mask, padded_len, pad_id: int, label_pad: int = C.LABEL_PAD):
    """Right padding: ids with pad_id, labels with -100, attention mask with 0."""
    def pad(a, v):
        return F.concat(a, F.array_repeat(F.lit(v), (F.col(padded_len) - F.size(a)).cast("int")))
    return pad(F.col(ids), pad_id), pad(F.col(labels), label_pad), pad(F.col(mask), 0)

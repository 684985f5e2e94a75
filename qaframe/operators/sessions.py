"""Per-session message memory in batch form.

Messages are (session_id, seq, role, content).  The last-N cut is a
row_number filter, which Spark turns into a partial WindowGroupLimit before
the shuffle: every task sends at most N rows per session, so a session
holding a third of all rows still moves only N rows per task.  The other
per-session values are aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X


def messages_from_conversations(conv: DataFrame) -> DataFrame:
    return conv.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"),
                       "role", F.col("text").alias("content"))


def api_role(role) -> F.Column:
    """'user' for a human message, otherwise 'assistant'."""
    r = X.col_(role)
    return F.when(r == "user", F.lit("user")).otherwise(F.lit("assistant"))


def last_n(messages: DataFrame, n: int = C.SESSION_MEMORY, session: str = "session_id",
           seq: str = "seq") -> DataFrame:
    """Keep the last n messages of every session (by seq)."""
    w = Window.partitionBy(session).orderBy(F.col(seq).desc())
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def after_last_clear(messages: DataFrame, is_clear, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Messages after the last clear event of their session (clear events
    themselves dropped).  The clear position is an aggregate per session
    (partial aggregation), joined back; AQE broadcasts it when small and
    splits skewed sessions otherwise."""
    m = messages.withColumn("_clear", is_clear)
    last = m.filter("_clear").groupBy(session).agg(F.max(seq).alias("_last_clear"))
    j = m.join(last, session, "left")
    return (j.filter(~F.col("_clear") & (F.col(seq) > F.coalesce(F.col("_last_clear"), F.lit(-1))))
            .drop("_clear", "_last_clear"))


def completed_pairs(messages: DataFrame, session: str = "session_id", seq: str = "seq", block: int = 4096) -> DataFrame:
    """Messages of completed exchanges: a user message and the assistant message
    that follows it.  Questions without an answer are never remembered.

    Neighbours are found inside ranges of `block` sequence numbers; across their ends
    by one row per range (its first and last role, an aggregate).  So a long session
    is many tasks, and only its ranges, not its messages, meet in one."""
    m = messages.withColumn("_block", F.floor(F.col(seq) / block))
    role = F.struct(F.col("role").alias("r"))            # a null role is a neighbour too
    ends = m.groupBy(session, "_block").agg(F.min_by(role, seq).alias("_first"), F.max_by(role, seq).alias("_last"))
    ranges = Window.partitionBy(session).orderBy("_block")
    ends = ends.select(session, "_block", F.lead("_first").over(ranges).alias("_after"), F.lag("_last").over(ranges).alias("_prior"))
    inside = Window.partitionBy(session, "_block").orderBy(seq)
    m = m.withColumn("_next", F.lead(role).over(inside)).withColumn("_before", F.lag(role).over(inside))
    m = m.join(ends, [session, "_block"])
    after, before = F.coalesce("_next", "_after")["r"], F.coalesce("_before", "_prior")["r"]
    asked = (F.col("role") == "user") & (after == "assistant")
    answered = (F.col("role") == "assistant") & (before == "user")
    return m.where(asked | answered).select(*messages.columns)


def lookup_history(requests: DataFrame, memory: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """History of each requested session; an unknown one is empty."""
    h = requests.select(session).distinct().join(history(memory, session, seq), session, "left")
    return h.select(session, F.coalesce("n_messages", F.lit(0)).cast("long").alias("n_messages"),
                    F.coalesce("transcript", F.lit("")).alias("transcript"))


def history(memory: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """One row per session: message count and the transcript in order
    (`role: content` lines).  Groups are already cut to N messages."""
    g = memory.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(
        F.col(seq).alias("s"), F.concat(api_role("role"), F.lit(": "), F.coalesce("content", F.lit(""))).alias("l")
    ))).alias("_m"))
    return g.select(session, F.size("_m").cast("long").alias("n_messages"),
                    F.array_join(F.transform("_m", lambda x: x["l"]), "\n").alias("transcript"))


def titles(messages: DataFrame, session: str = "session_id", seq: str = "seq",
           max_chars: int = C.TITLE_MAX) -> DataFrame:
    """Title = first user message, cut to max_chars + '…'."""
    first = (messages.filter(F.col("role") == "user").groupBy(session)
             .agg(F.min_by("content", seq).alias("_first")))
    return first.select(session, X.truncate("_first", max_chars, max_chars, C.TITLE_ELLIPSIS).alias("title"))


def session_count(messages: DataFrame, session: str = "session_id") -> DataFrame:
    return messages.agg(F.count_distinct(session).alias("n_sessions"))

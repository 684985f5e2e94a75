"""Session memory on a stream: bounded, clearable per-session state.

`applyInPandasWithState` keeps, per session, at most N messages plus the
position of the last clear event.  Each micro-batch merges the new rows of a
session into its state, drops what a clear event removed, keeps the last N by
seq (so rows arriving late inside the kept tail are placed correctly, older
ones fall off), and emits the session's memory with a version number.  The
sink is append-only; readers keep the highest version per session.

A session's rows of one micro-batch meet in one task; bound that with the
source's per-trigger limit (maxFilesPerTrigger / maxOffsetsPerTrigger).

`event_memory_stream` is the form in event time: a watermark drops what comes too
late, and sessions that stay idle leave the state.  `state_memory` reads the memory
out of the stream's state store, as a request for a session does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import constants as C
from ..session import scratch_dir
from ..sources.corpus import stream_table

OUT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("version", T.LongType()),
])
STATE = T.StructType([
    T.StructField("seq", T.ArrayType(T.LongType())),
    T.StructField("role", T.ArrayType(T.StringType())),
    T.StructField("content", T.ArrayType(T.StringType())),
    T.StructField("cleared_at", T.LongType()),
    T.StructField("version", T.LongType()),
])


def _memory_fn(n: int, clear_role: str | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            seq, role, content, cleared_at, version = state.get
            cur = pd.DataFrame({"seq": list(seq), "role": list(role), "content": list(content)})
        else:
            cur, cleared_at, version = pd.DataFrame({"seq": [], "role": [], "content": []}), -1, 0
        # folded part by part: never more than n rows and one part are held
        for p in pdfs:
            cur = pd.concat([cur, p[["seq", "role", "content"]]], ignore_index=True)
            if clear_role is not None:
                clears = cur.loc[cur["role"] == clear_role, "seq"]
                if len(clears):
                    cleared_at = max(int(cleared_at), int(clears.max()))
                cur = cur[(cur["role"] != clear_role) & (cur["seq"] > cleared_at)]
            cur = cur.sort_values("seq").tail(n)
        version += 1
        state.update((cur["seq"].astype("int64").tolist(), cur["role"].tolist(), cur["content"].tolist(),
                      int(cleared_at), int(version)))
        if len(cur):
            yield pd.DataFrame({"session_id": key[0], "seq": cur["seq"].astype("int64"), "role": cur["role"],
                                "content": cur["content"], "version": version})
        else:   # a tombstone: the new version of the session is empty
            yield pd.DataFrame({"session_id": [key[0]], "seq": pd.array([None], dtype="Int64"), "role": [None],
                                "content": [None], "version": [version]})
    return fn


def memory_stream(messages: DataFrame, n: int = C.SESSION_MEMORY, clear_role: str | None = None) -> DataFrame:
    """Streaming DataFrame of per-session memory snapshots (append mode)."""
    return messages.groupBy("session_id").applyInPandasWithState(
        _memory_fn(n, clear_role), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Current memory: rows of the highest version of each session.  A version
    that emptied a session is one row without a seq, dropped here."""
    newest = snapshots.groupBy("session_id").agg(F.max("version").alias("version"))
    return snapshots.join(newest, ["session_id", "version"], "left_semi").where("seq is not null").drop("version")


EVENT_STATE = T.StructType([*STATE.fields[:3], T.StructField("version", T.LongType())])
EVENTS = T.StructType([*OUT.fields[:4], T.StructField("ts", T.TimestampType())])


def _event_memory_fn(n: int, idle_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def emptied(version: int) -> pd.DataFrame:
            return pd.DataFrame({"session_id": [key[0]], "seq": pd.array([None], dtype="Int64"), "role": [None],
                                 "content": [None], "version": [version]})

        if state.hasTimedOut:                            # idle: forgotten, and its snapshot emptied
            version = state.get[3] + 1
            state.remove()
            yield emptied(version)
            return
        seq, role, content, version = state.get if state.exists else ([], [], [], 0)
        cur = pd.DataFrame({"seq": list(seq), "role": list(role), "content": list(content)})
        watermark, newest = state.getCurrentWatermarkMs(), 0
        for p in pdfs:
            at = p["ts"].astype("datetime64[ms]").astype("int64")
            p = p[at >= watermark]                       # later than the allowed delay: dropped
            newest = max(newest, int(at.max()))
            cur = pd.concat([cur, p[["seq", "role", "content"]]], ignore_index=True).sort_values("seq").tail(n)
        if newest < watermark and not state.exists:
            return                                       # nothing but late rows of a session unknown
        # above the version of an expired state of this session, which lay `idle` before
        version = max(int(version) + 1, newest)
        state.update((cur["seq"].astype("int64").tolist(), cur["role"].tolist(), cur["content"].tolist(), version))
        state.setTimeoutTimestamp(max(newest, watermark) + idle_ms)
        yield pd.DataFrame({"session_id": key[0], "seq": cur["seq"].astype("int64"), "role": cur["role"],
                            "content": cur["content"], "version": version})
    return fn


def event_memory_stream(events: DataFrame, n: int = C.SESSION_MEMORY, delay: str = "1 hour",
                        idle_ms: int = 30 * 24 * 3_600_000) -> DataFrame:
    """Snapshots of each session's last n rows by seq, in event time.

    `events` has session_id, seq, role, content and ts.  Rows that come more than
    `delay` behind the newest one seen are dropped (the watermark's rule); a session
    without rows for `idle_ms` of event time is forgotten, and its state removed."""
    return (events.withWatermark("ts", delay).groupBy("session_id")
            .applyInPandasWithState(_event_memory_fn(n, idle_ms), OUT, EVENT_STATE, "append", GroupStateTimeout.EventTimeTimeout))


def _run(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, snapshots,
         per_trigger: int | None = 1) -> str:
    """Run a stream over the files present now into a Parquet sink; returns its folder
    (`out` and `checkpoint`) under the shared checkpoint folder."""
    base = scratch_dir(spark, "session-stream")
    src = stream_table(spark, source_dir, file_glob, schema, per_trigger)
    q = (snapshots(src).writeStream.format("parquet").option("checkpointLocation", base + "/checkpoint")
         .option("path", base + "/out").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def run_memory_stream(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType,
                      to_messages, n: int, clear_role: str | None = None) -> DataFrame:
    """The current memory after a stream over the files present now, read back from its sink."""
    base = _run(spark, source_dir, file_glob, schema, lambda src: memory_stream(to_messages(src), n, clear_role))
    return latest_snapshot(spark.read.schema(OUT).parquet(base + "/out"))


def run_event_memory_stream(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, to_events,
                            n: int, per_trigger: int | None = 1, **params) -> DataFrame:
    """The same in event time.  Files that are not in the order of time have to come in one
    trigger (`per_trigger` None), or the watermark of the first ones drops rows of the others."""
    base = _run(spark, source_dir, file_glob, schema, lambda src: event_memory_stream(to_events(src), n, **params), per_trigger)
    return latest_snapshot(spark.read.schema(OUT).parquet(base + "/out"))


def run_state(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, to_messages, n: int,
              clear_role: str | None = None) -> str:
    """Run the memory stream; returns its checkpoint, whose state `state_memory` reads."""
    return _run(spark, source_dir, file_glob, schema, lambda src: memory_stream(to_messages(src), n, clear_role)) + "/checkpoint"


def state_memory(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(session_id, seq, role, content) out of the stream's own state, after its last
    batch or after batch number `batch`: no sink is read."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(checkpoint).select("key.session_id", "value.groupState.*")
    rows = state.select("session_id", F.explode(F.arrays_zip("seq", "role", "content")).alias("m"))
    return rows.select("session_id", "m.seq", "m.role", "m.content")


def session_count_stream(messages: DataFrame, precision: int = 14) -> DataFrame:
    """A running sketch of the distinct sessions: one mergeable state of bounded size
    (2 ** precision registers), merged at every trigger."""
    return messages.agg(F.hll_sketch_agg("session_id", precision).alias("sketch"))


def run_session_count(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, to_messages) -> DataFrame:
    """The number of sessions a stream has seen, estimated from its newest sketch.

    Every trigger writes its sketch under its number; a trigger that runs again
    writes the same one."""
    base = scratch_dir(spark, "session-count")
    src = stream_table(spark, source_dir, file_glob, schema)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).coalesce(1).write.mode("overwrite").parquet(f"{base}/sketches/{epoch:09d}")

    q = (session_count_stream(to_messages(src)).writeStream.foreachBatch(write).outputMode("complete")
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    sketches = spark.read.schema("sketch binary, epoch int").parquet(f"{base}/sketches/*")
    return sketches.agg(F.max_by("sketch", "epoch").alias("sketch")).select(
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("n_sessions"))

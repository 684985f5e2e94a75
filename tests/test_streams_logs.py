"""Event-time sessions, sketches, the state store, the JSON log, the model slot, file stamps."""

import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaframe.operators import logs, sessions, vectors
from qaframe.plans import catalog
from qaframe.sources import files, points
from qaframe.streaming import sessions as S

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = "session_id string, seq long, role string, content string, ts timestamp"


def write_files(spark, path, batches, schema):
    """One Parquet file per batch, in the order in which the stream reads them."""
    os.makedirs(path)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp-{i}")
        name = next(f for f in os.listdir(f"{path}/tmp-{i}") if f.endswith(".parquet"))
        os.link(f"{path}/tmp-{i}/{name}", f"{path}/{i:02d}.parquet")
        os.utime(f"{path}/{i:02d}.parquet", (1000 + i, 1000 + i))
    return spark.createDataFrame([], schema).schema


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def event_memory(spark, path, batches, n=3, idle_hours=48):
    schema = write_files(spark, path, batches, EVENTS)
    mem = S.run_event_memory_stream(spark, path, "*.parquet", schema, lambda x: x, n, delay="2 hours",
                                    idle_ms=idle_hours * 3_600_000)
    return {(r["session_id"], r["seq"]) for r in mem.collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark changes nothing; one within the delay takes its place."""
    first = [("a", 10, "user", "x", at(10)), ("b", 1, "user", "y", at(10))]
    second = [("a", 9, "user", "in time", at(9)), ("b", 2, "user", "z", at(12))]     # watermark 8 h
    third = [("a", 3, "user", "late", at(3)), ("c", 1, "user", "late", at(2)), ("a", 11, "user", "new", at(11))]   # watermark 10 h
    got = event_memory(spark, f"{tmp_path}/s", [first, second, third], n=5)
    assert got == {("a", 9), ("a", 10), ("a", 11), ("b", 1), ("b", 2)}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """A session idle for two days leaves the state; when it comes back it starts anew."""
    batches = [[("a", 1, "user", "x", at(0)), ("b", 1, "user", "x", at(0))], [("b", 2, "user", "y", at(40))],
               [("b", 3, "user", "z", at(80))], [("b", 4, "user", "z", at(81))], [("a", 5, "user", "back", at(82))]]
    assert event_memory(spark, f"{tmp_path}/s", batches) == {("a", 5), ("b", 2), ("b", 3), ("b", 4)}
    assert event_memory(spark, f"{tmp_path}/t", batches[:4]) == {("b", 2), ("b", 3), ("b", 4)}
    assert event_memory(spark, f"{tmp_path}/u", batches, idle_hours=1000) == {("a", 1), ("a", 5), ("b", 2), ("b", 3), ("b", 4)}


MESSAGES = "session_id string, seq long, role string, content string"


def test_sketch_over_many_triggers(spark, tmp_path):
    """Sessions that come again in later files count once."""
    batches = [[(f"s{i}", 0, "user", "x") for i in range(lo, lo + 900)] for lo in (0, 300, 600, 600)]
    schema = write_files(spark, f"{tmp_path}/s", batches, MESSAGES)
    n = S.run_session_count(spark, f"{tmp_path}/s", "*.parquet", schema, lambda x: x).first()["n_sessions"]
    assert abs(n - 1500) <= 0.03 * 1500
    schema = write_files(spark, f"{tmp_path}/e", [[]], MESSAGES)
    assert S.run_session_count(spark, f"{tmp_path}/e", "*.parquet", schema, lambda x: x).first()["n_sessions"] == 0


def test_lookup_from_the_state(spark, tmp_path):
    """The state store answers as the batch form does, now and after an earlier trigger."""
    batches = [[("a", i, "user", f"m{i}") for i in range(4)] + [("b", 0, "user", "hi")], [("a", 9, "assistant", "last")]]
    schema = write_files(spark, f"{tmp_path}/s", batches, MESSAGES)
    checkpoint = S.run_state(spark, f"{tmp_path}/s", "*.parquet", schema, lambda x: x, 3)
    all_rows = spark.createDataFrame(batches[0] + batches[1], MESSAGES)
    asked = spark.createDataFrame([("a",), ("b",), ("nobody",)], "session_id string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    now = sessions.lookup_history(asked, S.state_memory(spark, checkpoint))
    assert rows(now) == rows(sessions.lookup_history(asked, sessions.last_n(all_rows, 3)))
    first = sessions.lookup_history(asked, S.state_memory(spark, checkpoint, 0))
    assert rows(first) == rows(sessions.lookup_history(asked, sessions.last_n(spark.createDataFrame(batches[0], MESSAGES), 3)))


def test_log_with_any_keys(spark, tmp_path):
    path = f"{tmp_path}/log"
    entries = spark.createDataFrame(
        [(1, 0.5, {"loss": 1.5, "grad_norm": 2.0}, "10:00"), (2, 0.5, {"epoch": 7.0, "step": 20.0, "eval_loss": None}, None),
         (3, None, {}, "10:02"), (4, 1.0, {"timestamp": 9.0, "eval_loss": 0.25}, "10:03")],
        "step long, epoch double, metrics map<string,double>, timestamp string")
    lines = sorted((json.loads(r["value"]) for r in logs.log_lines(entries).collect()), key=lambda x: x["step"])
    assert {"step": 1, "epoch": 0.5, "loss": 1.5, "grad_norm": 2.0, "timestamp": "10:00"} in lines
    assert {"step": 20.0, "epoch": 7.0} in lines                       # the later key wins
    assert {"step": 4, "epoch": 1.0, "eval_loss": 0.25, "timestamp": "10:03"} in lines
    logs.append_log(entries, path)
    logs.append_log(entries.where("step = 1").withColumn("step", F.lit(5).cast("long")), path)
    with open(f"{path}/part-broken.json", "w") as f:
        f.write('{"step": 6, "loss"\n{"step": 7, "loss": "text", "new": {"a": [1]}}\n')
    got = {r["step"]: r for r in logs.read_log(spark, path).collect()}
    assert set(got) == {1, 20, 3, 4, 5, 7}                              # a broken line is left out
    assert got[1]["loss"] == got[5]["loss"] == 1.5 and got[20]["epoch"] == 7.0 and got[20]["timestamp"] is None
    assert got[7]["loss"] is None and got[3]["epoch"] is None
    keys = {r["key"]: r["n_lines"] for r in logs.log_keys(spark, path).collect()}
    assert keys["grad_norm"] == 2 and keys["new"] == 1 and keys["step"] == 6


def test_model_is_loaded_once_a_task(spark, tmp_path):
    model, loads = f"file://{tmp_path}/m.f8", f"{tmp_path}/loads"
    os.makedirs(loads)
    files.write_bytes(model, np.arange(26 * 8, dtype="<f8").reshape(26, 8).tobytes())

    def load():
        import uuid
        open(f"{loads}/{uuid.uuid4().hex}", "w").close()
        return catalog.letter_projection(model)
    rows = [(i, t, None) for i, t in enumerate(["abc", "", None, "zzz", "Zz", "été 123"] * 60)]
    df = spark.createDataFrame(rows, "id long, t string, other array<int>").repartition(3).checkpoint()
    out = vectors.embed_with_model(df, "t", "v", load, 8, prefix="", batch=7).collect()
    assert len(os.listdir(loads)) == 3 and len(out) == len(rows)
    matrix = np.arange(26 * 8, dtype=float).reshape(26, 8)
    for r in out:
        want = sum((matrix["abcdefghijklmnopqrstuvwxyz".index(c)] for c in r["t"] or "" if "a" <= c <= "z"), np.zeros(8))
        size = np.linalg.norm(want)
        assert np.allclose(r["v"], want / size if size else want) and r["other"] is None
    with pytest.raises(Exception, match="shape"):
        vectors.embed_with_model(df, "t", "v", load, 9, prefix="").collect()


def test_stamp_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).coalesce(1).write.parquet(path)
    first = points.stamp(spark, path)
    assert points.stamp(spark, path) == first
    spark.range(1).write.mode("append").parquet(path)
    assert points.stamp(spark, path) != first


def test_chunk_ids_without_moving_chunks(spark, monkeypatch):
    """Between the samples and their points stands no exchange: starts join before chunking."""
    p = catalog.build_points(spark, "/root/testdata/sf0.001")
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert plan.index("_chunks") < join and "vector" not in plan[join:]
    rows = p.select("chunk_id", "sample_id").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows)))
    assert [r["sample_id"] for r in rows] == sorted(r["sample_id"] for r in rows)


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """The tables as folders of three files each."""
    d = str(tmp_path_factory.mktemp("folders"))
    for t in ("documents", "conversations", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(60).repartition(3).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("stream,batch", [("session_count_stream", None), ("session_state_lookup", "session_lookup"),
                                          ("session_memory_stream", "session_memory"),
                                          ("session_memory_events_stream", "session_memory_events"),
                                          ("index_stream", "chunks")])
def test_streams_over_tables_that_are_folders(spark, folder_tables, stream, batch):
    """A table of several files in a folder is read as one file is."""
    got = catalog.QUERIES[stream](spark, folder_tables)
    if batch is None:
        assert got.first().n_sessions > 0 and got.first().within_bound
        return
    want = catalog.QUERIES[batch](spark, folder_tables)
    both = [c for c in want.columns if c in got.columns]
    rows = lambda df: sorted(map(repr, df.select(*both).collect()))
    assert rows(got) == rows(want) and got.count() > 0


def test_stream_batches_are_dealt_to_all_cores(spark, tmp_path):
    """A batch is a file, which may be one row group, that is one task of chunking and embedding."""
    from qaframe.session import TEXT_PARTITIONS
    from qaframe.sources import corpus
    spark.range(100).selectExpr("id doc_id", "cast(id as string) text").coalesce(1).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    before = spark.conf.get(TEXT_PARTITIONS)
    spark.conf.set(TEXT_PARTITIONS, "0")
    try:
        wide = corpus.spread_wide(docs, "doc_id")
        assert wide.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert wide.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
        assert sorted(r.doc_id for r in wide.collect()) == list(range(100))
        plan = catalog.build_points(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(TEXT_PARTITIONS, before)
    assert "steps(" not in plan and "counts(" in plan        # texts are cut into steps once, before


def test_each_distinct_token_is_hashed_once(spark, monkeypatch):
    import hashlib
    import pyarrow as pa
    hashed = []
    monkeypatch.setattr(vectors, "md5", lambda b: hashed.append(b) or hashlib.md5(b))
    tokens = ["a", "", "été", "a", "日本", "a", "été"]
    got = vectors.token_buckets(pa.array(tokens), 64).tolist()
    assert got == [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64 if t else -1 for t in tokens]
    assert len(hashed) == len(set(hashed)) <= 4
    monkeypatch.undo()
    texts = [None, "", " ", "A b, B", "x" * 50, "é É e", "1 2 3 1"]
    rows = vectors.hash_embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").collect()
    for r in rows:
        want = np.zeros(64)
        for t in "".join(c if c.isalnum() else " " for c in (r.t or "").lower()).split():
            want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64] += 1
        n = np.sqrt((want * want).sum())
        assert r.vector == (want / n if n else want).tolist()


def test_points_are_written_where_they_are_made(spark, folder_tables, monkeypatch):
    """A batch exchanges its texts, never its points; files that nothing refers to go after each batch,
    and parts whose points all came again are not written anew."""
    from qaframe.sources.versioned import Collection
    written, seen = [], []
    write, vacuum = Collection._write, Collection.vacuum
    monkeypatch.setattr(Collection, "_write", lambda self, rows: written.append(
        rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows))
    monkeypatch.setattr(Collection, "vacuum", lambda self, keep=2: (vacuum(self, keep), seen.append(self))[0])
    got = catalog.QUERIES["index_stream"](spark, folder_tables)
    assert len(written) == len(seen) == 6                   # three files, twice
    for plan in written:
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
        assert plan.index("Exchange hashpartitioning") > plan.index("counts(")          # below the embedding
    table = seen[-1]
    assert len(table.versions()) == 2
    used = {p for n in table.versions() for parts in table.version(n).buckets.values() for p in parts}
    assert {p.split("/")[1] for p in used} == set(table.folder.names("data"))
    assert got.count() == got.select("sample_id", "chunk_pos").distinct().count() > 0


def test_collection_by_place(spark, tmp_path):
    """Rows lie by a column that the key determines: replaced in part, in whole, merged."""
    from qaframe.sources import versioned
    from qaframe.sources.versioned import Collection
    schema = "k string, doc long, p string"

    def rows(docs, p, copies=1):
        made = [(f"{d}:{i}" if d is not None else f"{i}", d, f"{p}{d}{c}") for d in docs for i in range(3) for c in range(copies)]
        return spark.createDataFrame(made, schema).repartition(8, "doc")
    table = Collection.ensure(spark, f"{tmp_path}/c", spark.createDataFrame([], schema).schema, "k", 4, "doc")
    with pytest.raises(ValueError):
        Collection.ensure(spark, f"{tmp_path}/c", spark.createDataFrame([], schema).schema, "k", 4)
    want = {}

    def upsert(docs, p, copies=1):
        incoming = rows(docs, p, copies)
        for r in points.last_by_key(incoming, "k").collect():
            want[r["k"]] = r["p"]
        table.upsert(incoming)
        have = table.read().collect()
        assert {r["k"]: r["p"] for r in have} == want and len(have) == len(want)
    upsert([*range(20), None], "a", copies=3)
    upsert([*range(10, 30), None], "b")
    before = table.folder.names("data")
    upsert([*range(10, 30), None], "c", copies=2)
    assert len(table.folder.names("data")) == len(before) + 1       # the rows of "b" went without a write
    table.vacuum(1)
    assert len(table.folder.names("data")) <= 3
    keep = versioned.BROADCAST_KEYS
    for versioned.BROADCAST_KEYS in (0, keep):
        upsert([3, 12], f"d{versioned.BROADCAST_KEYS}")
    most = versioned.MAX_PARTS
    versioned.MAX_PARTS = 2
    try:
        upsert(range(40, 60), "e")
    finally:
        versioned.MAX_PARTS = most
    assert all(len(parts) <= 2 for parts in table.version().buckets.values())


def test_runs_of_keys():
    import pyarrow as pa
    runs = lambda keys, before=None: points.begins_run(pa.array(keys, pa.string()), before).tolist()
    assert runs(["a", "a", None, None, "b"]) == [True, False, True, False, True]
    assert runs(["a", None], pa.array(["a"])) == [False, True]
    assert runs([None, "a"], pa.array([None], pa.string())) == [False, True]
    assert runs([None]) == [True]

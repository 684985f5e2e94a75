"""Split/limit/pad golden cases, upsert idempotence, sessions, plan checks."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from qaframe.operators import batches, ids, sessions
from qaframe.sources import points
from qaframe.sources.versioned import Collection


def ids_df(spark, n, parts=3):
    return spark.range(n).select(F.col("id").alias("sample_id")).repartition(parts)


def test_split_sizes(spark):
    for n, (tr, ev) in {10: (8, 2), 11: (8, 3)}.items():
        c = {r["split"]: r["count"] for r in batches.train_eval_split(ids_df(spark, n)).groupBy("split").count().collect()}
        assert c == {"train": tr, "eval": ev}


def test_split_independent_of_partitions(spark):
    a = {tuple(r) for r in batches.train_eval_split(ids_df(spark, 500, 1)).collect()}
    b = {tuple(r) for r in batches.train_eval_split(ids_df(spark, 500, 7), digits=1).collect()}
    assert a == b and len(a) == 500


def test_limits(spark):
    def sizes(n, m):
        df = batches.limited_splits(ids_df(spark, n), m)
        return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes(125, 50) == {"train": 50, "eval": 2}     # train has 100
    assert sizes(30, 30) == {"train": 24, "eval": 1}      # train has 24
    assert sizes(30, 0) == {"train": 24, "eval": 6}
    assert sizes(30, None) == {"train": 24, "eval": 6}


def test_padding(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 1, 9), (3, 2, 8), (4, 3, 3)], "sample_id long, pos long, n long")
    got = {r["sample_id"]: r["padded_len"] for r in batches.padded_lengths(rows, "n").collect()}
    assert got == {1: 16, 2: 16, 3: 8, 4: 8}
    df = spark.createDataFrame([([1, 2], 8)], "ids array<int>, L long")
    df = df.withColumn("mask", F.transform("ids", lambda x: F.lit(1)))
    i, lab, m = batches.pad_arrays("ids", "ids", "mask", "L", 0)
    r = df.select(i.alias("i"), lab.alias("l"), m.alias("m")).first()
    assert r["i"] == [1, 2, 0, 0, 0, 0, 0, 0] and r["l"] == [1, 2] + [-100] * 6
    assert r["m"] == [1, 1, 0, 0, 0, 0, 0, 0]


def test_dense_positions_partition_independent(spark):
    df = spark.createDataFrame([(s, p) for s in range(50) for p in range(s % 4)], "sample_id long, chunk_pos int")
    for parts, bucket_rows in ((1, 8192), (7, 3)):
        d = ids.dense_positions(df.repartition(parts), ids.id_bucket("sample_id", bucket_rows),
                                [F.col("sample_id"), F.col("chunk_pos")], "cid")
        got = sorted((r["sample_id"], r["chunk_pos"], r["cid"]) for r in d.collect())
        assert [g[2] for g in got] == list(range(len(got)))


def collection(spark, schema, key="id", n_buckets=4, **declared):
    path = os.path.join(tempfile.mkdtemp(prefix="qaframe-test-"), "c")
    return Collection.ensure(spark, path, spark.createDataFrame([], schema).schema, key, n_buckets, **declared)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_twice_is_once(spark):
    table = collection(spark, "id long, p string")
    a = spark.createDataFrame([(i, f"a{i}") for i in range(20)], "id long, p string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(10, 30)], "id long, p string")
    assert table.read().count() == 0
    table.upsert(a)
    table.upsert(b)
    once = rows_of(table.read())
    table.upsert(b)
    assert rows_of(table.read()) == once == [(i, f"a{i}") for i in range(10)] + [(i, f"b{i}") for i in range(10, 30)]
    table.upsert(a.limit(0))
    assert rows_of(table.read()) == once


def test_upsert_keeps_the_last_of_equal_keys(spark):
    schema = "id long, seq long, p string"
    old = spark.createDataFrame([(1, 0, "old"), (2, 0, "kept")], schema)
    new = spark.createDataFrame([(1, 1, "z first"), (1, 2, "a last"), (3, 1, "x"), (3, 1, "x")], schema)
    want = [(1, 2, "a last"), (2, 0, "kept"), (3, 1, "x")]
    assert rows_of(points.upsert(old, new.repartition(3), "id", "seq")) == want
    table = collection(spark, schema)
    table.upsert(new, "seq")
    assert rows_of(table.read()) == [want[0], want[2]]
    ties = spark.createDataFrame([(7, 1, f"t{i}") for i in range(9)] + [(7, 1, None)], schema)
    picked = {rows_of(points.last_by_key(ties.repartition(n), "id", "seq"))[0] for n in (1, 3, 7)}
    assert len(picked) == 1                              # whatever the partitioning


def test_versions_are_whole(spark):
    """A reader between two commits sees one version; a writer that dies changes nothing."""
    table = collection(spark, "id long, p string", dim=3)
    first = spark.createDataFrame([(i, "a") for i in range(40)], "id long, p string")
    second = spark.createDataFrame([(i, "b") for i in range(0, 60, 5)], "id long, p string")
    n1 = table.upsert(first)
    pinned = table.read()
    before = rows_of(pinned)
    n2 = table.upsert(second)
    assert rows_of(pinned) == before == rows_of(table.read(n1))        # read after the commit, still the old version
    now = rows_of(table.read(n2))
    assert now == sorted([(i, "b") for i in range(0, 60, 5)] + [(i, "a") for i in range(40) if i % 5])

    class Dies(Collection):
        def _commit(self, version):
            raise KeyboardInterrupt
    with pytest.raises(KeyboardInterrupt):
        Dies(spark, table.path).upsert(first.withColumn("p", F.lit("lost")))
    assert rows_of(table.read()) == now and table.versions() == [0, n1, n2]
    files = {os.path.join(d, f) for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}
    gone = table.vacuum(keep=1)
    left = {os.path.join(d, f) for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}
    assert gone and left < files and table.versions() == [n2] and rows_of(table.read()) == now
    with pytest.raises(ValueError):
        Collection.ensure(spark, table.path, first.schema, "id", dim=4)


def test_two_writers(spark):
    """A writer that finds its version taken starts again from the newer one."""
    table = collection(spark, "id long, p string")
    other = Collection(spark, table.path)
    mine = spark.createDataFrame([(1, "mine"), (2, "mine")], "id long, p string")
    theirs = spark.createDataFrame([(2, "theirs"), (3, "theirs")], "id long, p string")

    class Late(Collection):
        raced = False

        def _commit(self, version):
            if not Late.raced:
                Late.raced = True
                other.upsert(theirs)
            return super()._commit(version)
    assert Late(spark, table.path).upsert(mine) == 2
    assert rows_of(table.read()) == [(1, "mine"), (2, "mine"), (3, "theirs")]


def test_epochs_are_applied_once(spark):
    table = collection(spark, "id long, p string")
    batch = lambda p: spark.createDataFrame([(1, p)], "id long, p string")
    assert table.upsert(batch("a"), stream="s", epoch=0) == 1
    assert table.upsert(batch("again"), stream="s", epoch=0) == 1
    assert table.upsert(batch("b"), stream="other", epoch=0) == 2
    assert table.upsert(batch("c"), stream="s", epoch=1) == 3
    assert table.upsert(batch("late"), stream="s", epoch=0) == 3
    assert rows_of(table.read()) == [(1, "c")]


def test_prefix_starts_with_sparse_keys(spark):
    rows = [(i, i % 3) for i in range(500)] + [(1 << 40, 2), (-5, 7)]
    got = {r["k"]: r["start"] for r in ids.prefix_starts(
        spark.createDataFrame(rows, "k long, w long"), ["k"], "w").collect()}
    at = 0
    for k, w in sorted(rows):
        assert got[k] == at
        at += w


def test_stream_clear_over_many_files(spark):
    """Each file is a micro-batch; a clear that empties a session must show."""
    import random
    from qaframe.streaming import sessions as S
    rows = [("a", 1, "user", "x"), ("a", 2, "assistant", "y"), ("b", 1, "user", "p"), ("a", 3, "system", ""), ("c", 1, "user", "q"),
            ("c", 2, "system", ""), ("c", 3, "user", "r"), ("b", 2, "assistant", "s")]
    schema = exchanges(spark, 1).schema
    want = {("b", 1), ("b", 2), ("c", 3)}
    for order in (rows, random.Random(1).sample(rows, len(rows)), random.Random(2).sample(rows, len(rows))):
        d = tempfile.mkdtemp(prefix="qaframe-stream-")
        for i, r in enumerate(order):
            spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{d}/part-{i}")
        flat = tempfile.mkdtemp(prefix="qaframe-stream-")
        for i in range(len(order)):
            f = next(x for x in os.listdir(f"{d}/part-{i}") if x.endswith(".parquet"))
            os.link(f"{d}/part-{i}/{f}", f"{flat}/{i:02d}.parquet")
            os.utime(f"{flat}/{i:02d}.parquet", (1000 + i, 1000 + i))
        got = S.run_memory_stream(spark, flat, "*.parquet", schema, lambda x: x, 20, clear_role="system").collect()
        assert {(r["session_id"], r["seq"]) for r in got} == want


def exchanges(spark, n_ex):
    rows = []
    for i in range(n_ex):
        rows += [("s", 2 * i, "user", f"u{i}"), ("s", 2 * i + 1, "assistant", f"a{i}")]
    return spark.createDataFrame(rows, "session_id string, seq long, role string, content string")


def test_session_memory_last_20(spark):
    m = sessions.last_n(exchanges(spark, 11), 20)
    got = [r["content"] for r in m.orderBy("seq").collect()]
    assert got == [x for i in range(1, 11) for x in (f"u{i}", f"a{i}")]


def test_session_memory_plan_limits_before_shuffle(spark):
    plan = sessions.last_n(exchanges(spark, 11), 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_history_roles_and_unknown(spark):
    m = spark.createDataFrame([("s", 0, "user", "hi"), ("s", 1, "system", "x")],
                              "session_id string, seq long, role string, content string")
    h = sessions.history(m).first()
    assert h["transcript"] == "user: hi\nassistant: x" and h["n_messages"] == 2
    req = m.sparkSession.createDataFrame([("s",), ("nope",)], "session_id string")
    got = {r["session_id"]: r["n_messages"] for r in req.join(sessions.history(m), "session_id", "left").collect()}
    assert got == {"s": 2, "nope": None}


def test_titles(spark):
    m = spark.createDataFrame([("s", 1, "user", "x" * 40), ("s", 3, "user", "late")],
                              "session_id string, seq long, role string, content string")
    assert sessions.titles(m).first()["title"] == "x" * 28 + "…"


def test_completed_pairs_across_ranges(spark):
    """Pairs do not depend on where the sequence ranges end; gaps and null roles included."""
    import random
    rng = random.Random(4)
    rows = []
    for k in ("a", "b", "c"):
        for q in sorted(rng.sample(range(400), 120)):
            rows.append((k, q, rng.choice(["user", "assistant", "assistant", "system", None]), f"{k}{q}"))
    df = spark.createDataFrame(rows, "session_id string, seq long, role string, content string").repartition(5)
    want = set()
    for k in ("a", "b", "c"):
        own = [r for r in rows if r[0] == k]
        for x, y in zip(own, own[1:]):
            if (x[2], y[2]) == ("user", "assistant"):
                want |= {x[3], y[3]}
    for block in (1, 7, 4096):
        out = sessions.completed_pairs(df, block=block)
        assert out.columns == df.columns and {r["content"] for r in out.collect()} == want


def test_upsert_leaves_untouched_parts(spark, monkeypatch):
    """New keys are added as parts of their own; only a part that holds a replaced key is written again."""
    from qaframe.sources import versioned
    table = collection(spark, "id long, p string")
    rows = lambda lo, hi, p: spark.createDataFrame([(i, p) for i in range(lo, hi)], "id long, p string")
    parts = lambda: {p for held in table.version().buckets.values() for p in held}
    seen = [set()]
    for i in range(3):
        table.upsert(rows(40 * i, 40 * i + 40, "a"))
        assert seen[-1] < parts()                        # nothing written before is written again
        seen.append(parts())
    table.upsert(rows(50, 51, "b"))
    assert seen[1] <= parts() and len(seen[2] - parts()) == 1
    want = sorted((i, "b" if i == 50 else "a") for i in range(120))
    assert rows_of(table.read()) == want
    none = spark.createDataFrame([(None, "x")], "id long, p string")
    table.upsert(none)
    table.upsert(none)                                   # a null key equals none
    assert rows_of(table.read().where("id is null")) == [(None, "x")] * 2
    monkeypatch.setattr(versioned, "MAX_PARTS", 3)
    table.upsert(rows(200, 240, "c"))
    assert max(map(len, table.version().buckets.values())) <= 3
    assert rows_of(table.read().where("id is not null")) == sorted([*want, *((i, "c") for i in range(200, 240))])
    table.vacuum(keep=1)
    assert rows_of(table.read().where("id is not null")) == sorted([*want, *((i, "c") for i in range(200, 240))])

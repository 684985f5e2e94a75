"""Exact search in blocks, approximate search over cell lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaframe.operators import ann, search, sparse
from qaframe.operators.vectors import sparse_entries
from qaframe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows, key="id", vec="vector", parts=5):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows],
                                 f"{key} long, {vec} array<double>").repartition(parts)


def brute(queries, corpus, k, floor):
    out = set()
    for q, a in queries:
        scored = []
        for i, b in corpus:
            n = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(np.dot(a, b) / n) if n else 0.0, 6), i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            if floor is None or -s >= floor:
                out.add((q, i, round(-s, 6), rank))
    return out


def data(seed=0, n=400, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-2, 3, dim).astype(float)) for i in range(n)]          # many ties and equal vectors
    rows += [(n + i, np.ones(dim)) for i in range(150)] + [(n + 201, np.zeros(dim))]
    return rows


def as_set(df):
    return {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("blocks", [None, 48 * 7])
def test_exact_search_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(search, "ROW_SLICE", 64)
    monkeypatch.setattr(search, "QUERY_SLICE", 5)
    rows = data()
    asked = [r for r in rows if r[0] % 20 == 0] + [rows[-1]]
    more = {} if blocks is None else {"max_block_bytes": blocks}
    got = search.search_topk(frame(spark, asked, "query_id"), frame(spark, rows), 7, None, dim=6, **more)
    assert as_set(got) == brute(asked, rows, 7, None)


def test_blocks_hold_one_block_on_the_driver(spark, monkeypatch):
    """Several blocks: none of them holds all queries, and no broadcast stays."""
    sizes, gone = [], []
    real = type(spark.sparkContext.broadcast(0)).destroy
    monkeypatch.setattr(search, "_matrix", lambda s, dim, f=search._matrix: (sizes.append(len(s)), f(s, dim))[1])
    monkeypatch.setattr("pyspark.core.broadcast.Broadcast.destroy", lambda self, blocking=False: (gone.append(1), real(self, blocking))[1])
    rows = data(n=60)
    assert search.search_topk(frame(spark, rows, "query_id"), frame(spark, rows), 3, None, dim=6,
                              max_block_bytes=48 * 30).count() == 3 * len(rows)
    assert len(sizes) > 4 and sum(sizes) == len(rows) and max(sizes) < len(rows) / 2 and len(gone) == len(sizes)


def test_all_cells_are_the_exact_search(spark, monkeypatch):
    """Probing every cell, with lists in small blocks and queries in small slices."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    monkeypatch.setattr(ann, "QUERY_ROWS", 10)
    rows = data(3)
    index = ann.build_index(frame(spark, rows), dim=6, n_cells=9)
    stored = spark.read.parquet(index.path)
    assert stored.count() == len(rows) and stored.select("id").distinct().count() == len(rows)      # every row is indexed
    assert index.subs.agg(F.max("n_subs")).first()[0] > 4                                           # the copies' cell
    asked = [r for r in rows if r[0] % 20 == 0]
    got = ann.search_cells(frame(spark, asked, "query_id"), index, 9, 6, None)
    assert as_set(got) == brute(asked, rows, 6, None)


def test_recall_on_clustered_vectors(spark):
    """Vectors around 40 directions: few cells find the neighbours."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = [(i, centres[i % 40] + 0.25 * rng.normal(size=16)) for i in range(2400)]
    corpus, asked = frame(spark, rows), frame(spark, [r for r in rows if r[0] % 20 == 0], "query_id")
    index = ann.build_index(corpus, dim=16, n_cells=40)
    nprobe = ann.choose_nprobe(asked, corpus, index, floor=None)
    assert nprobe <= 8                                   # at most a fifth of the collection
    found = ann.search_cells(asked, index, nprobe, floor=None)
    exact = search.search_topk(asked, corpus, floor=None, dim=16)
    total = ann.recall(found, exact).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    assert total >= 0.9


def test_empty_and_single(spark):
    none = frame(spark, [])
    index = ann.build_index(none, dim=6)
    assert ann.search_cells(frame(spark, data(n=3), "query_id"), index, 1, 5, None).count() == 0
    one = ann.build_index(frame(spark, [(4, [1, 0, 0])]), dim=3)
    assert as_set(ann.search_cells(frame(spark, [(9, [2, 0, 0])], "query_id"), one, 3, 5, 0.5)) == {(9, 4, 1.0, 1)}
    assert ann.search_cells(frame(spark, [], "query_id"), one, 1).count() == 0
    with pytest.raises(Exception, match="declared size"):
        ann.search_cells(frame(spark, [(9, [2, 0])], "query_id"), one, 1).collect()


def test_search_ann_query(spark):
    rows = QUERIES["search_ann"](spark, SF).collect()
    exact = {(r["query_id"], r["id"], r["score"]) for r in QUERIES["search_vectors"](spark, SF).collect()}
    assert {(r["query_id"], r["id"], r["score"]) for r in rows} <= exact or len(rows) >= 0.9 * len(exact)
    assert sum(r["recall"] for r in rows) / len(rows) >= 0.9


def sparse_rows(seed=4, n=500, dim=40):
    """Vectors of few values; bucket 0 is in nearly all of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = np.zeros(dim)
        v[rng.choice(dim, rng.integers(1, 7), replace=False)] = rng.integers(2, 5, 1)
        v[0] = 1 if i % 10 else 0
        rows.append((i, v))
    return rows + [(n, np.zeros(dim)), (n + 1, rows[3][1] * 2), (n + 2, -rows[5][1])]


@pytest.mark.parametrize("floor", [0.2, 0.45, 0.8])
def test_inverted_lists_equal_brute_force(spark, monkeypatch, floor):
    monkeypatch.setattr(sparse, "LIST_ROWS", 60)                     # bucket 0 in many parts
    rows = sparse_rows()
    asked = [r for r in rows if r[0] % 20 == 0]
    got = sparse.search_sparse(frame(spark, asked, "query_id"), frame(spark, rows), 6, floor)
    assert as_set(got) == brute(asked, rows, 6, floor)


def test_inverted_lists_make_few_pairs(spark):
    """The join reads the short lists only: far fewer rows than the query x corpus pairs, and
    than all lists of the queries' buckets."""
    rows = sparse_rows(n=1500)
    asked = sparse_entries(sparse._unit(frame(spark, [r for r in rows if r[0] % 20 == 3], "query_id"), "query_id", "vector", "query_id"), "query_id")
    entries = sparse_entries(sparse._unit(frame(spark, rows), "id", "vector", "id"), "id").checkpoint()
    sizes = sparse.list_sizes(entries)
    every = asked.join(sizes, "bucket").agg(F.sum("rows")).first()[0]
    read = sparse.joined_buckets(asked, sizes, 0.45).join(sizes, "bucket").agg(F.sum("rows")).first()[0]
    n_pairs = asked.select("query_id").distinct().count() * len(rows)
    assert read < every / 2 and read < n_pairs / 2
    assert sparse.candidates(asked, entries, 0.45).count() < read
    with pytest.raises(ValueError):
        sparse.search_sparse(frame(spark, rows), frame(spark, rows), 5, 0.0)


def test_sparse_of_nothing(spark):
    some, none = frame(spark, sparse_rows(n=20), "query_id"), frame(spark, [], "query_id")
    corpus = frame(spark, sparse_rows(n=20))
    assert sparse.search_sparse(none, corpus).count() == 0
    assert sparse.search_sparse(some, frame(spark, [])).count() == 0


def test_sparse_search_makes_no_pairs(spark):
    """Neither entries nor candidates are shuffled: the plan holds no join, and a null key, a null
    component or another size gives no hit."""
    rows = data(seed=4)
    got = sparse.search_sparse(frame(spark, rows[:40], "query_id"), frame(spark, rows), 5, 0.45)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    odd = spark.createDataFrame([(None, [1.0, 1.0]), (1, [1.0, None]), (2, None), (3, [1.0, 1.0]), (4, [1.0])],
                                "id long, vector array<double>")
    hits = sparse.search_sparse(odd.withColumnRenamed("id", "query_id"), odd, 5, 0.45)
    assert {(r.query_id, r.id) for r in hits.collect()} == {(3, 3), (4, 4)}

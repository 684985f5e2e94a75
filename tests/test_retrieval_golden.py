"""Golden cases for context, routing, prompts, search paths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from qaframe.operators import retrieval, search


def test_context_order_and_labels(spark):
    hits = spark.createDataFrame([
        (1, 1, 0.91, 7, "full", "F7"), (1, 2, 0.88, 7, "question", "Q7"), (1, 3, 0.80, 3, "solution", "S3"),
        (1, 4, 0.80, 4, "question", "Q4"), (1, 5, 0.60, None, "question", "X"),
    ], "query_id long, rank int, score double, sample_id long, chunk_type string, text string")
    ctx = retrieval.build_context(retrieval.dedup_hits(hits)).first()["context"]
    want = ("Bài toán tương tự (score=0.80):\nQ4\n\n---\n\nBài toán tương tự (score=0.60):\nX\n\n---\n\n"
            "Lời giải tham khảo (score=0.80):\nS3\n\n---\n\nBài toán hoàn chỉnh (score=0.91):\nF7")
    assert ctx == want


def test_context_cut_and_unknown_types(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1, "zzz", "a" * 2000), (1, 2, 0.8, 2, None, "b")],
                                 "query_id long, rank int, score double, sample_id long, chunk_type string, text string")
    ctx = retrieval.build_context(retrieval.dedup_hits(hits)).first()["context"]
    assert ctx.startswith("Tham khảo (score=0.80):\nb") and len(ctx) == 1503 and ctx.endswith("...")


def test_route(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    hits = spark.createDataFrame([(2, 0.99), (3, 0.78), (3, 0.5), (4, 0.7799), (4, 0.6)], "query_id long, score double")
    got = {r["query_id"]: (r["best_score"], r["n_hits"], r["use_web"]) for r in retrieval.route(q, hits).collect()}
    assert got == {1: (0.0, 0, True), 2: (0.99, 1, True), 3: (0.78, 2, False), 4: (0.7799, 2, True)}


def test_generation_prompt(spark):
    df = spark.createDataFrame([("q", None, None), ("q", "C", None), ("q", "C", "H")], "q string, c string, h string")
    got = [r["p"] for r in df.select(retrieval.generation_prompt("q", "c", "h").alias("p")).collect()]
    assert got == ["Câu hỏi: q", "### Ngữ cảnh từ dữ liệu:\nC\n\nCâu hỏi: q",
                   "### Ngữ cảnh từ dữ liệu:\nC\n\n### Gợi ý từ internet:\nH\n\nCâu hỏi: q"]


def brute_topk(Q, M, k):
    out = {}
    Q = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    for qi, q in enumerate(Q):
        s = np.round(M @ q, 6)
        order = sorted(range(len(M)), key=lambda j: (-s[j], j))[:k]
        out[qi] = [(j, s[j]) for j in order]
    return out


def test_search_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    M = rng.normal(size=(300, 8))
    M /= np.linalg.norm(M, axis=1, keepdims=True)
    M[5] = M[6]                       # exact tie: smaller id wins
    Q = M[:37] + 0.01
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(M)], "id long, vector array<double>") \
        .repartition(7)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "query_id long, vector array<double>")
    want = brute_topk(Q, M, 5)
    for max_bytes in (1 << 30, 256):   # one query block, then many
        res = search.search_topk(queries, corpus, k=5, floor=None, max_block_bytes=max_bytes, dim=8).collect()
        got = {}
        for r in res:
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for qi, lst in want.items():
            g = [(i, s) for _, i, s in sorted(got[qi])]
            assert [i for i, _ in g] == [i for i, _ in lst], (max_bytes, qi)
            assert all(math.isclose(a, b, abs_tol=1e-9) for (_, a), (_, b) in zip(g, lst))


def test_search_is_a_cosine_and_drops_nothing(spark):
    corpus = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["id"]): r["score"] for r in search.search_topk(queries, corpus, floor=None, dim=2).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): -0.707107, (2, 1): 0.0, (2, 2): 0.0, (2, 3): 0.0}
    other = spark.createDataFrame([(9, [1.0, 2.0, 3.0])], "query_id long, vector array<double>")
    with pytest.raises(ValueError):
        search.search_topk(queries.unionByName(other), corpus, dim=2)
    with pytest.raises(Exception, match="declared size"):
        search.search_topk(queries, corpus.unionByName(other.withColumnRenamed("query_id", "id")), dim=2).collect()


def test_search_of_stored_vectors(spark):
    """Every twentieth vector is a query and finds itself first."""
    sf = "/root/testdata/sf0.001"
    asked = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    first = {r.query_id: r.id for r in E.queries()["search_vectors"](spark, sf).where("rank = 1").collect()}
    assert first == {i: i for i in asked} and len(first) > 10

"""The pipeline's stages against the loops of the operators' tests."""

import collections

import numpy as np
import pytest

import corpus_pipeline as P

from .test_near import near_by_loop
from .test_quality_lines_shards import base_counts, lines_by_loop, line_rows, quality_rows

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "packing"]


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = P.quality_rules(spark, docs, SF)
    assert one.columns == docs.columns
    one = {r.doc_id: r for r in one.collect()}
    assert not any(base_counts(texts[i])[-1] for i in one) and len(one) > 0.7 * len(texts)
    for i, r in one.items():                              # lines go whole, in order
        it = iter(texts[i].split("\n"))
        assert all(x in it for x in r.text.split("\n")) and r.n_chars == len(r.text)
    left = spark.createDataFrame(list(one.values()), docs.schema)
    two = {r.doc_id: r.text for r in P.repeated_lines(spark, left, SF).collect()}
    assert two == {k[0]: k[3] for k in lines_by_loop([(i, r.text) for i, r in one.items()])}
    left = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in two.items()], docs.schema)
    three = {r.doc_id: r.text for r in P.near_duplicate_documents(spark, left, SF).collect()}
    keep = {k[0] for k in near_by_loop(list(two.items()), 5) if k[3]}
    assert three == {i: two[i] for i in keep}
    out = P.run(spark, SF).collect()
    tokens = collections.defaultdict(list)
    for r in out:
        tokens[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
    assert set(tokens) == set(three)
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.tokenizer("byte_bpe_50k.json"))
    for i, runs in tokens.items():
        ids = np.frombuffer(b"".join(r[2] for r in sorted(runs)), "<u4").tolist()
        assert ids == tokenizer.encode(three[i], add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name,fn", P.STAGES)
def test_odd_rows(make_docs, spark, name, fn):
    """Nulls in every column, empty texts, repeated rows, no rows, more columns."""
    rows = quality_rows() + line_rows() + [(None, None), (None, "a b c d e f"), (None, "a b c d e f")]
    docs = make_docs(rows, clashes=True)
    out = fn(spark, docs, SF)
    if name != "packing":
        assert out.columns == docs.columns
    out.collect()
    none = make_docs([])
    assert fn(spark, none, SF).count() == 0


def test_one_of_each_group_stays(make_docs, spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text), (1, text), (1, text), (2, text + " end"), (7, "other words"), (None, text), (None, text), (9, None)]
    out = P.near_duplicate_documents(spark, make_docs(rows), SF).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(False, 0), (False, 0), (True, 1), (True, 7), (True, 9)]


def test_rows_of_one_id_with_unequal_texts(make_docs, spark):
    """The row that stays does not depend on the order or the partitioning."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a + " more"), (2, "two"), (3, "three")]
    kept = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for parts in (1, 4):
            out = P.near_duplicate_documents(spark, make_docs(order, clashes=True).repartition(parts), SF)
            kept.add(tuple(sorted((r.doc_id, r.text) for r in out.collect())))
    assert len(kept) == 1 and [i for i, _ in next(iter(kept))] == [1, 2, 3]


def test_run_leaves_only_its_own_folder(spark):
    import os
    from qaframe.llm import common
    P.run(spark, SF).collect()
    own = [f for f in common._OPENED if "/pipeline-" in f and "near" not in f]
    assert common._OPENED == own and os.path.isdir(own[-1].removeprefix("file:"))

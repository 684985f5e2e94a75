"""Byte-level BPE, periodic runs and the Merkle manifest against the public
library, direct loops and hashlib."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaframe.llm import byte_bpe, manifest, runs
from qaframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ---- byte-level BPE

@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


ODD = ["", " ", "   ", "a  b", "\n\n a \t", "it's WE'LL 'll", "<|endoftext|> a", "日本語のテキスト été ñ 𝒳 👩‍👩‍👧", "x" * 5000,
       "ab" * 3000, "=" * 700 + "-" * 300, "\x1c\x85  　x", "123 4567 ½ ٣", "﻿ á", "aaaaaaab" * 40, "\x00\x01"]


@pytest.mark.parametrize("long_word", [8, 256])
def test_byte_bpe_equals_library(library, spark, monkeypatch, long_word):
    monkeypatch.setattr(byte_bpe, "LONG_WORD", long_word)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 300)             # the memory turns over
    model = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for lo in range(0, len(texts), 20):
        part = texts[lo:lo + 20]
        rows = [np.frombuffer(b, "<u4") for b in model.encode(part)]
        assert [r.tolist() for r in rows] == [library.encode_ordinary(t) for t in part]
        assert model.decode(np.array([len(r) for r in rows]), np.concatenate(rows).astype(np.int32)) == [t.encode() for t in part]


def test_every_character_is_cut_as_by_the_library(library):
    """White space, letters and numbers are the same in both pattern engines."""
    model = byte_bpe.model_of(RANKS, public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}." for c in chars[lo:lo + 512]) for lo in range(0, len(chars), 512)]
    for text, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_plain_characters_are_cut_alike(library):
    """Texts for which the faster matcher is used."""
    assert byte_bpe.GPT_PATTERN == public_tokenizers.PATTERN
    model = byte_bpe.model_of(RANKS, public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(0x2100) if not byte_bpe._ODD(chr(c))]
    assert len(chars) > 500 and not {"\x1c", "\x85", "\xa0", "\u2028", "\xb2", "\xbd", "\xd7"} & set(chars)
    texts = ["".join(f"a{c}1{c} {c}.{c}\n" for c in chars[lo:lo + 64]) for lo in range(0, len(chars), 64)]
    texts += ["it's WE'LL 'll", " a  b \n\n c\t", "\u201cx\u201d \u2026y\u2014z\u2019s"]
    assert not any(map(byte_bpe._ODD, texts))
    for text, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_byte_bpe_any_text(library, text):
    model = byte_bpe.model_of(RANKS, public_tokenizers.PATTERN)
    assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_byte_bpe_frames(make_docs, library):
    rows = [(1, "one two"), (1, "one two"), (None, "no key"), (2, None), (3, ""), (4, "long " * 30_000)]
    encoded = byte_bpe.encode_bytes(make_docs(rows, clashes=True), RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == collections.Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    decoded = byte_bpe.decode_bytes(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in decoded) == collections.Counter(
        (i, (t or "").encode()) for i, t in rows)
    assert byte_bpe.encode_bytes(make_docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
    part = encoded.select("doc_id", F.expr("slice(ids, 1, 1)").alias("ids")).where("doc_id = 4")       # a cut decodes too
    assert byte_bpe.decode_bytes(part, RANKS, public_tokenizers.PATTERN).first().bytes == b"long"
    unknown = encoded.select("doc_id", F.array(F.lit(60_000)).alias("ids"))
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode_bytes(unknown, RANKS, public_tokenizers.PATTERN).collect()


def test_op11_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op11_byte_bpe"](spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(docs[r.doc_id]))


# ---- periodic runs

def brute_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        t = 0
        while t + q < len(w):
            s = t
            while t + q < len(w) and w[t] == w[t + q]:
                t += 1
            if t > s and t - s + q >= max(least, exponent * q):
                found.setdefault((s, t - s + q), q)
            t += t == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


words = st.lists(st.sampled_from("abc"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(words, st.integers(0, 40), st.integers(1, 12)), min_size=1, max_size=4),
       st.sampled_from([(2, 2), (3, 6), (4, 6)]))
def test_runs_equal_loops(texts, limits):
    lists = [[(w[i] if i < a else w[a + (i - a) % p]).encode() for i in range(len(w))] if a + p <= len(w)
             else [x.encode() for x in w] for w, a, p in texts]
    got = [[tuple(r) for r in x.tolist()] for x in runs.runs_of(lists, *limits)]
    assert got == [brute_runs(w, *limits) for w in lists]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=80), st.data())
def test_grammar_extensions(symbols, data):
    n = len(symbols)
    full = np.array([7, *symbols, 8])
    i, j = sorted(data.draw(st.lists(st.integers(1, n), min_size=2, max_size=2, unique=True)))
    g = runs.Grammar(full)
    ahead = next(k for k in range(n + 2) if full[i + k] != full[j + k])
    behind = next(k for k in range(n + 2) if full[i - k] != full[j - k])
    one = lambda x: np.array([x])
    assert (g.extend(one(i), one(j))[0], g.extend_back(one(i), one(j))[0]) == (ahead, behind)


def test_runs_of_long_texts():
    for w in ([b"a"] * 50_000, [b"a", b"b"] * 30_000, [str(i % 999).encode() for i in range(60_000)]):
        q = len(set(w))
        assert runs.runs_of([w])[0].tolist() == [[0, len(w), q]]
    fib, nxt = [b"a"], [b"a", b"b"]                     # a word with many runs of low exponent
    while len(nxt) < 1500:
        fib, nxt = nxt, nxt + fib
    assert [tuple(r) for r in runs.runs_of([nxt], 2, 2)[0].tolist()] == brute_runs(nxt, 2, 2)


def test_runs_frames(make_docs, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    monkeypatch.setattr(runs, "GRID_BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (None, "x x x x x x x"), (63, "na " * 5), (63, "na " * 5),
             (64, "one\ntwo three " * 6), (65, "very long " * 40_000)]
    out = runs.periodic_runs(make_docs(rows, clashes=True))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect())
    want = collections.Counter()
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        found = brute_runs(w) if len(w) < 1000 else [(0, len(w), 2)]
        want[(i, len(w), tuple(found), brute_collapsed(w, found))] += 1
    assert got == want
    assert runs.periodic_runs(make_docs([])).count() == 0


def test_op12_query(spark, make_docs, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["x", "yy", "\n", "z"]) for _ in range(rng.randrange(70)))) for i in range(300)]
    rows += [(None, "q q q q q q"), (400, None), (401, ""), (7, "twice " * 9), (7, "twice " * 9)]
    make_docs(rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    want = collections.Counter()
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        want[(i, len(found), *best, 1000 * best[1] // best[2] if found else None,
              sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(brute_collapsed(w, found)))] += 1
    out = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == want and planted > 10


# ---- Merkle manifest

def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes):
    """(root, proof of every leaf as a list of (left, right))."""
    proofs = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, under = [], []
        for lo in range(0, len(nodes), 3):
            group = nodes[lo:lo + 3]
            for k in range(len(group)):
                for leaf in below[lo + k]:
                    proofs[leaf].append(("".join(group[:k]), "".join(group[k + 1:])))
            ups.append(sha("".join(group)))
            under.append(sum(below[lo:lo + 3], []))
        nodes, below = ups, under
    return (nodes[0] if nodes else None), proofs


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> Counter of result rows of the query."""
    leaf = lambda r: sha("".join(map(value, r)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = brute_tree([leaf(r) for r in groups[s]])
    root, above = brute_tree([trees[s][0] for s in names])
    out = collections.Counter()
    for s, up in zip(names, above):
        for r, own in zip(groups[s], trees[s][1]):
            path = own + up
            t = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and t is not None:
                t = t.replace("\n", "")
            node = leaf((*r[:4], t))
            for left, right in path:
                node = sha(left + node + right)
            out[(r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in path)), node, node == root)] += 1
    return out


def merkle_rows(n, sources, seed):
    rng = random.Random(seed)
    rows = [(i * 2 - 9, rng.choice(sources), rng.choice(["en", None]), rng.choice([5, None, 0]),
             rng.choice(["a\nb", "", None, "é\n" * 20, f"text {i}"])) for i in range(n)]
    return rows + [rows[0], (None, sources[0], "de", 1, "no id"), (None, sources[0], None, None, None)] if n else rows


@pytest.mark.parametrize("n, sources, levels", [(0, [None], 2), (1, ["s"], 2), (25, ["a", None, "", "Z", "é", "ab"], 1),
                                                (400, ["hot", "hot", "hot", "x", None], 2), (90, ["only"], 7)])
def test_op13_query(spark, tmp_path, monkeypatch, n, sources, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)              # blocks of 3, 9, 2,187 leaves
    rows = merkle_rows(n, sources, n)
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, v string, pos long, path string"
    spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], schema).repartition(5).write.parquet(
        f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = collections.Counter(map(tuple, out.collect()))
    assert got == brute_manifest(rows)


def test_manifest_paths(spark, monkeypatch):
    """The operator's own rows: every path folds to the root, a changed value does not; joins without broadcast."""
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BROADCAST_BLOCKS", 0)
    rows = [(r[0], r[1], r[4], i) for i, r in enumerate(merkle_rows(150, ["a", "b", "b"], 2))]
    df = spark.createDataFrame(rows, "key long, kind string, body string, id int")
    out = manifest.merkle_manifest(df, ["key", "body"], "kind", "key", {"block": F.col("id")})
    assert out.columns == ["key", "kind", "leaf", "subroot", "root", "path", "block"]
    folded = out.select(manifest.fold(F.col("path"), F.col("leaf")).alias("a"), "root",
                        manifest.fold(F.col("path"), manifest.digest(F.lit("other"))).alias("b"), "block").collect()
    assert {r.a for r in folded} == {folded[0].root} and all(r.b != r.root for r in folded)
    assert sorted(r.block for r in folded) == list(range(len(rows)))


def test_manifest_windows_hold_a_block(spark):
    """Every window over nodes is dealt by (group, block), with one exchange for all levels."""
    df = spark.range(5000).select(F.concat(F.lit("1"), F.col("id") % 1).alias("g"), F.col("id").alias("pos"), F.lit(5000).alias("cnt"),
                                  F.sha2(F.col("id").cast("string"), 256).alias("v"))
    plan = manifest._climb(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(g" in plan and "block" in plan

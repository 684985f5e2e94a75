"""Operators 4 and 10 against all-pairs loops."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaframe.llm.components import components
from qaframe.llm.embeddings import near_vectors
from qaframe.llm import minhash
from qaframe.llm.minhash import near_duplicates
from qaframe.llm.shingles import Bands, shingle_sets, signatures, word_hashes

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    for c in STRIP:
        text = text.replace(c, " ")
    return [w for w in text.translate(LOWER).split(" ") if w]


def shingles(text, k):
    w = words_of(text or "")
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near_by_loop(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    union = Union()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                union.join(i, j)
    return collections.Counter((i, len(s), None if i is None else union.find(i), i is None or union.find(i) == i)
                               for i, s in sets)


def got_near(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates(make_docs):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(14):                                   # groups around the threshold, chains included
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(rng.randrange(1, 9)):
            text = changed(rng, base, rng.randrange(0, max(2, len(base) // 30)))
            rows.append((len(rows), text))
            base = text.split() if rng.random() < 0.5 else base
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three"),
             (None, rows[0][1]), (None, ""), (906, rows[3][1].upper()), (907, rows[5][1] + "\n"),
             (908, rows[7][1]), (908, rows[20][1]), (5, rows[5][1]),
             (909, " ".join(vocabulary * 8)), (910, " ".join(vocabulary * 8) + " end")]
    rng.shuffle(rows)
    for k in (4, 5):
        assert got_near(near_duplicates(make_docs(rows, clashes=True), words=k)) == near_by_loop(rows, k)


def test_hot_bucket(make_docs):
    """One large group whose members are near the base but not all near each
    other, one of exact copies, and a passage that many documents share."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, changed(rng, base, rng.randrange(0, 5))) for i in range(10, 160)]
    rows += [(i, "the very same words in every copy of this text") for i in range(200, 300)]
    passage = " ".join(f"p{i}" for i in range(80))
    rows += [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(300, 380)]
    assert got_near(near_duplicates(make_docs(rows), words=4)) == near_by_loop(rows, 4)


def test_tiles_of_one_outsider(spark):
    """A bucket of k members with m minors gives about k + m * blocks rows, not k * blocks."""
    for k in (5_000, 80_000):
        live = spark.range(k).select(F.lit(7).cast("long").alias("key"), F.lit(0).alias("band"), "id", F.lit(50).cast("long").alias("n"),
                                     F.when(F.col("id") == 17, 17).otherwise(0).cast("long").alias("comp"))
        tiles = minhash._tiles(live)
        assert k <= tiles.count() <= k + k * 50 / minhash.TILE_SHINGLES + k / minhash.TILE + 2
        worst = tiles.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0]
        assert worst <= 2 * minhash.TILE + 100


def test_pairs_of_tiles(spark, monkeypatch):
    """Every pair of different components meets in exactly one tile, as member and probe."""
    monkeypatch.setattr(minhash, "TILE", 4)
    rng = random.Random(5)
    comps = {i: rng.choice([0, 0, 0, 0, 1, 2, i]) for i in range(60)}
    live = spark.createDataFrame([(3, 0, i, 10, c) for i, c in comps.items()], "key long, band int, id long, n long, comp long")
    tiles = collections.defaultdict(list)
    for r in minhash._tiles(live).collect():
        tiles[(r.key, r.i, r.j)].append(r)
    met = collections.Counter()
    for rows in tiles.values():
        for p in rows:
            for x in rows:
                if p.side == 1 and x.side == 0 and p.comp != x.comp and (not x.minor or x.id < p.id):
                    met[frozenset((p.id, x.id))] += 1
    assert met == collections.Counter(frozenset((a, b)) for a in comps for b in comps if a < b and comps[a] != comps[b])


def test_near_duplicates_empty(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert got_near(near_duplicates(make_docs([(1, None), (2, "")]))) == near_by_loop([(1, None), (2, "")], 5)


def test_words_and_shingles():
    rng = random.Random(6)
    texts = ["", " ", "a", "A a\tB", "é É", "a\x0bb\x0cc\r\nd e", "x" * 5000] + [
        "".join(rng.choice("aAbé \n\t") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    by_word = collections.defaultdict(set)
    for w, h in zip([w for t in texts for w in words_of(t)], hashes.tolist()):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    for k in (1, 3, 5):
        flat, offsets = shingle_sets(texts, k)
        assert np.diff(offsets).tolist() == [len(shingles(t, k)) for t in texts]


def test_minima_estimate_similarity():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[300:] + [f"v{i}" for i in range(300)])]
    flat, offsets = shingle_sets(texts, 1)
    minima, _ = signatures(flat, offsets, Bands(60, 5))
    assert abs((minima[0] == minima[1]).mean() - 2700 / 3300) < 0.08


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    n = 120
    edges = {"path": [(i, i + 1) for i in rng.sample(range(n), n)], "star": [(n, i) for i in range(n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(3, 3)], "none": []}[shape]
    union = Union()
    for a, b in edges:
        if a != b:
            union.join(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: union.find(x) for x in list(union.parent)}


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def vectors_by_loop(rows, cosine=0.95):
    def usable(i, v):
        return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    union, n = Union(), [0] * len(rows)
    for x, (i, v) in enumerate(rows):
        for y, (j, w) in enumerate(rows[:x]):
            if usable(i, v) and usable(j, w) and len(v) == len(w):
                a, b = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    n[x] += 1
                    n[y] += 1
                    union.join(i, j)
    return collections.Counter((i, n[x], None if i is None else union.find(i), i is None or union.find(i) == i)
                               for x, (i, _) in enumerate(rows))


def test_near_vectors(spark, monkeypatch):
    import qaframe.llm.embeddings as E
    monkeypatch.setattr(E, "BLOCK", 64)                       # many pivots, several blocks in a cell
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 16)):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=16) * 0.22]))
    one = [float(x) for x in rng.normal(size=16)]
    rows += [(1000 + i, one) for i in range(150)] + [(1200 + i, [x * (i + 2) for x in one]) for i in range(5)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + one[1:]), (2004, [None] + one[1:]),
             (2005, [float("inf")] + one[1:]), (None, one), (2006, [1.0, 0.0]), (2007, [1.0, 0.1]), (2008, [3.0]),
             (2009, [1e-30] * 16), (2010, [1e30] * 16), (3, rows[3][1]), (4, rows[40][1])]
    df = spark.createDataFrame(rows, VECTORS)
    from pyspark.sql import functions as F
    for name in ("id", "vec", "cell", "home", "rep", "c", "label", "h1", "side"):
        df = df.withColumn(name, F.lit("clash"))
    out = near_vectors(df).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == vectors_by_loop(rows)


def test_near_vectors_empty(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_queries(spark):
    from qaframe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got_near(QUERIES["op4_minhash_near_dedup"](spark, sf)) == near_by_loop(docs, 4)
    vecs = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = QUERIES["op10_embedding_near_dedup"](spark, sf).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == vectors_by_loop(vecs)

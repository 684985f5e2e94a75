"""BPE parity with the public `tokenizers` package; training log; sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from qaframe import constants as C
from qaframe.operators import bpe, logs
from qaframe.sources import points

# FIXED VALUES: the three inputs of the original's encode/decode inspection
INSPECTED = [
    "Tính diện tích hình tròn bán kính 5 cm.",
    "Giải phương trình $x^2 - 5x + 6 = 0$",
    "The answer is $\\frac{{3}}{{4}}$.",
]
TEXTS = INSPECTED + [f"[SYS]Bạn là trợ lý.[/SYS][USR]Bài {i}: tính {i} + {i * 3} bằng bao nhiêu?[/USR]"
     f"[AST]Ta có {i} + {i * 3} = {i * 4}. Vậy đáp số là {i * 4}.[/AST][EOS]" for i in range(60)]


def hf_tokenizer(texts, vocab_size):
    tk = pytest.importorskip("tokenizers")
    from tokenizers.decoders import ByteLevel as ByteLevelDecoder
    from tokenizers.models import BPE
    from tokenizers.normalizers import NFKC
    from tokenizers.pre_tokenizers import ByteLevel
    from tokenizers.trainers import BpeTrainer
    tok = tk.Tokenizer(BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = ByteLevel(add_prefix_space=False)
    tok.normalizer = NFKC()
    tok.decoder = ByteLevelDecoder()
    tr = BpeTrainer(vocab_size=vocab_size, min_frequency=2, special_tokens=C.SPECIAL_TOKENS,
                    show_progress=False, initial_alphabet=ByteLevel.alphabet())
    tok.train_from_iterator(texts, trainer=tr)
    return tok


def test_bpe_parity(spark):
    vocab_size = 330
    df = spark.createDataFrame(list(enumerate(TEXTS)), "sample_id long, text string").repartition(3)
    vocab, merges = bpe.learn_bpe(spark, df, vocab_size=vocab_size)
    hf = hf_tokenizer(TEXTS, vocab_size)
    model = json.loads(hf.to_str())["model"]
    v = {r["id"]: r["token"] for r in vocab.collect()}
    assert {t: i for i, t in v.items()} == model["vocab"]
    hf_merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ours = [(v[r["left"]], v[r["right"]]) for r in merges.orderBy("rank").collect()]
    assert ours == hf_merges
    enc = {r["sample_id"]: r for r in bpe.encode(df, "sample_id", "text", vocab, merges, max_len=24).collect()}
    dec = {r["sample_id"]: r["text"] for r in
           bpe.decode(bpe.encode(df, "sample_id", "text", vocab, merges), "sample_id", vocab).collect()}
    for i, t in enumerate(TEXTS):
        ids = hf.encode(t).ids
        assert enc[i]["input_ids"] == ids[:24]
        assert enc[i]["labels"] == enc[i]["input_ids"]
        assert enc[i]["truncated"] == (len(ids) > 24)
        assert dec[i] == hf.decode(ids, skip_special_tokens=False)


SELF_PAIRS = [(["aaaa"] * 100 + ["cd"] * 90 + ["ef"] * 40, 4), (["aaa"] * 50 + ["xy"] * 40 + ["----"] * 30 + ["======="] * 20, 9),
              (["0000000"] * 7 + ["00"] * 9 + ["10"] * 8 + ["ab0"] * 5, 6)]


@pytest.mark.parametrize("budget", [1, 10**6])
@pytest.mark.parametrize("words,n", SELF_PAIRS)
def test_bpe_runs_of_one_symbol(spark, words, n, budget):
    """A merge of a symbol with itself makes pairs of its own result."""
    size = 267 + n
    vocab, merges = bpe.learn_bpe(spark, spark.createDataFrame([(w,) for w in words], "text string"), vocab_size=size,
                                  round_symbols=budget)
    v = {r["id"]: r["token"] for r in vocab.collect()}
    model = json.loads(hf_tokenizer(words, size).to_str())["model"]
    hf_merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    assert [(v[r["left"]], v[r["right"]]) for r in merges.orderBy("rank").collect()] == hf_merges


@pytest.mark.parametrize("budget,rounds", [(300, 60), (1500, 20), (10**6, 1)])
def test_bpe_order_with_many_ties(spark, budget, rounds):
    """Small counts: most pairs tie.  Rounds that list few pairs, some, and all of them;
    the counts kept by differences equal those counted anew."""
    import random
    rng = random.Random(3)
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(400)] + ["aa" * 3, "zz" * 5] * 3
    size = 267 + 400
    vocab, merges = bpe.learn_bpe(spark, spark.createDataFrame([(" ".join(words),)], "text string"), vocab_size=size,
                                  round_symbols=budget)
    assert bpe.learn_bpe.last_rounds <= rounds
    v = {r["id"]: r["token"] for r in vocab.collect()}
    model = json.loads(hf_tokenizer([" ".join(words)], size).to_str())["model"]
    hf_merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    assert [(v[r["left"]], v[r["right"]]) for r in merges.orderBy("rank").collect()] == hf_merges


def test_replay_of_a_long_list_of_words():
    """20,000 words, a merge after the other in under a second each thousand: places are linked
    arrays, no word is walked again for a merge that it does not hold."""
    import random
    import time
    import numpy as np
    rng = random.Random(5)
    words = [[rng.randrange(11, 40) for _ in range(rng.randrange(2, 30))] for _ in range(20000)]
    freqs = np.array([rng.randrange(1, 9) for _ in words])
    size = np.array([len(w) for w in words])
    counts = {}
    for w, f in zip(words, freqs.tolist()):
        for a, b in zip(w, w[1:]):
            counts[a << 32 | b] = counts.get(a << 32 | b, 0) + f
    strings = [f"<{i}>" for i in range(40)]
    begun = time.process_time()
    chain = bpe._Chain(size, np.concatenate([np.array(w) for w in words]), freqs, np.sort(np.array(list(counts))))
    merges = bpe._replay(chain, dict(counts), None, strings, {s: i for i, s in enumerate(strings)}, 3000, 2)
    assert time.process_time() - begun < 3 and len(merges) == 3000
    ranks = {(a, b): (i, t) for i, (a, b, t) in enumerate(merges)}
    want = [bpe.merge_symbols(w, ranks) for w in words[:500]]
    have = [[x for x in chain.sym[lo:hi].tolist() if x >= 0] for lo, hi in zip(np.cumsum(size) - size, np.cumsum(size))]
    assert have[:500] == want


def test_registered_bpe_queries_equal_the_library(spark):
    """Whole corpus of the smallest data: counts, merges, ids, padded arrays."""
    import __spark_entry__ as E
    from qaframe.plans import catalog
    sf = "/root/testdata/sf0.001"
    texts = {r["sample_id"]: r["text"] for r in catalog.training_texts_df(spark, sf).collect()}
    hf = hf_tokenizer([texts[k] for k in sorted(texts)], C.VOCAB_SIZE)
    q = {n: E.queries()[n](spark, sf) for n in ("nfkc_texts", "pretoken_counts", "bpe_merges", "encode_texts",
                                                "padded_encoded_batches", "vocab_specials")}
    import collections
    import unicodedata
    norm = {k: unicodedata.normalize("NFKC", t) for k, t in texts.items()}
    assert {r["sample_id"]: r["text"] for r in q["nfkc_texts"].collect()} == norm
    pre = collections.Counter()
    for t in norm.values():
        pre.update(t[a:b] for _, (a, b) in hf.pre_tokenizer.pre_tokenize_str(t))
    assert {r["token"]: r["freq"] for r in q["pretoken_counts"].collect()} == dict(pre)
    model = json.loads(hf.to_str())["model"]
    merges = {r["token"]: r["id"] for r in q["bpe_merges"].collect()}
    assert merges.items() <= model["vocab"].items() and len(merges) == len(model["merges"])
    ids = {k: hf.encode(t).ids for k, t in texts.items()}
    got = {r["sample_id"]: r for r in q["encode_texts"].collect()}
    assert {k: r["ids"] for k, r in got.items()} == {k: " ".join(map(str, v[:C.MAX_SEQ_LEN])) for k, v in ids.items()}
    assert {k: r["truncated"] for k, r in got.items()} == {k: len(v) > C.MAX_SEQ_LEN for k, v in ids.items()}
    n = [min(len(v), C.MAX_SEQ_LEN) for v in ids.values()]
    stats = E.queries()["bpe_length_stats"](spark, sf).first()
    assert (stats["n_texts"], stats["max_len"], stats["min_len"]) == (len(n), max(n), min(n))
    assert abs(stats["avg_len"] - sum(n) / len(n)) < 1e-6
    by_batch = collections.defaultdict(list)
    for r in q["padded_encoded_batches"].collect():
        by_batch[r["batch_id"]].append(r)
    for rows in by_batch.values():
        want = -(-max(len(ids[r["sample_id"]][:C.MAX_SEQ_LEN]) for r in rows) // 8) * 8
        for r in rows:
            x = ids[r["sample_id"]][:C.MAX_SEQ_LEN]
            pad = want - len(x)
            assert (r["ids"], r["lab"], r["mask"]) == tuple(" ".join(map(str, x2)) for x2 in (
                x + [0] * pad, x + [-100] * pad, [1] * len(x) + [0] * pad))
    specials = {r["token"]: r["id"] for r in q["vocab_specials"].collect()}
    assert specials.pop("<vocab_size>") == len(model["vocab"])
    assert specials == {t: model["vocab"][t] for t in C.SPECIAL_TOKENS}


def test_pair_counts_by_differences(spark):
    """After merges, the updated pair table equals one made from the changed words."""
    words = spark.createDataFrame([([1, 2, 1, 2, 3], 5), ([1, 1, 1], 2), ([3, 2], 7), ([2, 1, 2, 3, 1, 2], 1)],
                                  "s array<int>, f long").withColumn("l", F.size("s").cast("long"))
    pairs = bpe._sum_pairs(bpe._pair_rows(words))
    both = bpe._merge_words(spark, words, [(1, 2, 9), (9, 3, 10)])
    changed = both.where("old is not null")
    before = changed.select(F.col("old").alias("s"), "f", F.size("old").cast("long").alias("l"))
    updated = bpe._sum_pairs(pairs.unionByName(bpe._pair_rows(before, -1)).unionByName(bpe._pair_rows(changed.drop("old"))))
    anew = bpe._sum_pairs(bpe._pair_rows(both.drop("old")))
    assert sorted(map(tuple, updated.collect())) == sorted(map(tuple, anew.collect()))
    assert sorted(r["s"] for r in both.collect()) == [[1, 1, 1], [2, 10, 9], [3, 2], [9, 10]]


def test_merge_of_a_long_word():
    """A run of letters without a space: n log n, and the library's result."""
    import time
    hf = hf_tokenizer(TEXTS + ["na" * 50, "aaaa" * 9], 400)
    model = json.loads(hf.to_str())["model"]
    ranks = {}
    for i, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        ranks[model["vocab"][a], model["vocab"][b]] = (i, model["vocab"][a + b])
    word = "banana" * 30_000 + "aaaaa" * 4_000
    t0 = time.perf_counter()
    got = bpe._encode_word(word, ranks)
    assert time.perf_counter() - t0 < 20
    assert got == hf.encode(word).ids


def test_special_ids_and_byte_map():
    assert bpe.CHAR_ID[bpe.ALPHABET[0]] == len(C.SPECIAL_TOKENS)
    assert len(set(bpe.BYTE_CHARS)) == 256
    assert bpe.BYTE_CHARS[ord("a")] == "a" and bpe.BYTE_CHARS[32] == chr(256 + 32)


def test_training_log(spark):
    d = tempfile.mkdtemp(prefix="qaframe-log-")
    lines = [{"step": 10, "epoch": 0.1, "loss": 1.23456, "learning_rate": 1e-5, "timestamp": "10:00:00"},
             {"step": 20, "epoch": 0.2, "eval_loss": 0.0, "timestamp": "10:01:00"},
             {"step": 30, "epoch": 0.3, "loss": 0.5, "eval_loss": 0.7, "timestamp": "10:02:00"}]
    with open(os.path.join(d, "training_log.jsonl"), "w") as f:
        for x in lines:
            f.write(json.dumps(x) + "\n")
    log = logs.read_log(spark, d)
    rep = {r["step"]: r for r in logs.log_report(log).collect()}
    assert rep[10]["message"] == "step=    10 | epoch=0.1 | loss=1.2346 | lr=0.0"
    assert rep[10]["learning_rate_raw"] == 1e-5
    odd = spark.createDataFrame([(1, 2.0, 12345678.9, 0.0, 2e-4, "t"), (2, 0.5, 10.0, 100.25, 1.0, "t")], log.schema)
    assert [r["message"] for r in logs.log_report(odd).orderBy("step").collect()] == [
        "step=     1 | epoch=2.0 | loss=12345678.9 | eval_loss=0.0 | lr=0.0002",
        "step=     2 | epoch=0.5 | loss=10.0 | eval_loss=100.25 | lr=1.0"]
    assert rep[20]["message"] == "step=    20 | epoch=0.2 | eval_loss=0.0"
    best = logs.best_checkpoint(log).first()
    assert best["best_step"] == 20 and best["best_eval_loss"] == 0.0


def test_materialize_once_and_split_sink(spark):
    base = tempfile.mkdtemp(prefix="qaframe-sink-")
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    b = spark.createDataFrame([(2, "y")], "id long, v string")
    p = os.path.join(base, "corpus")
    assert [r["id"] for r in points.materialize_once(spark, a, p).collect()] == [1]
    assert [r["id"] for r in points.materialize_once(spark, b, p).collect()] == [1]   # saved copy wins
    os.remove(os.path.join(p, "_SUCCESS"))                    # the remains of a failed write are written again
    assert [r["id"] for r in points.materialize_once(spark, b, p).collect()] == [2]
    s = spark.createDataFrame([(1, "train"), (2, "eval")], "id long, split string")
    points.write_splits(s, os.path.join(base, "splits"))
    assert sorted(x for x in os.listdir(os.path.join(base, "splits")) if x.startswith("split=")) == \
        ["split=eval", "split=train"]
    back = spark.read.parquet(os.path.join(base, "splits")).filter(F.col("split") == "train")
    assert [r["id"] for r in back.collect()] == [1]


def test_chunk_sink_fingerprint(spark):
    base = tempfile.mkdtemp(prefix="qaframe-chunks-")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id long, v string")
    assert points.fingerprint(a) == points.fingerprint(a.repartition(2).orderBy(F.desc("id")))
    assert points.fingerprint(a) != points.fingerprint(b)
    swapped = [spark.createDataFrame([r], "p string, q string") for r in ((None, "a"), ("a", None))]
    assert points.fingerprint(swapped[0]) != points.fingerprint(swapped[1])
    first = points.chunk_sink(spark, a, lambda d: d.withColumn("n", F.length("v")), base)
    second = points.chunk_sink(spark, b, lambda d: d.withColumn("n", F.length("v")), base)
    assert sorted(r["v"] for r in first.collect()) == ["x", "y"]
    assert sorted(r["v"] for r in second.collect()) == ["x", "z"]     # changed input, new chunks


def test_pretokens_by_whole_arrays():
    """The cutter finds what the pattern finds; texts marked whole stay one piece."""
    import random
    import numpy as np
    rng = random.Random(1)
    alphabet = list("abstrevlmd''   \n\t.,!-19éđ日本　́٢½\U0001f600\x85")
    for _ in range(3000):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        whole = np.array([rng.random() < 0.2 for _ in texts])
        tokens, owner = bpe.cut_pretokens(texts, whole)
        got = [[] for _ in texts]
        for token, i in zip(tokens.to_pylist(), owner.tolist()):
            got[i].append(token)
        assert got == [[t] * bool(t) if w else bpe._PRETOKEN.findall(t) for t, w in zip(texts, whole)]


def test_pretoken_counts_of_odd_texts(spark):
    import collections
    texts = [None, "", " ", "it's 'll  x\n", "ﬁne ½", "we're 'tis \n\n 12a", "it's"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    import unicodedata
    want = collections.Counter(x for t in texts for x in bpe._PRETOKEN.findall(unicodedata.normalize("NFKC", t or "")))
    assert {r["token"]: r["freq"] for r in bpe.pretoken_counts(df).collect()} == dict(want)
    assert bpe.pretoken_counts(df.limit(0)).count() == 0


def test_words_are_encoded_together():
    """As from a heap word by word: lowest rank first, of these the leftmost; merges that give
    an earlier token again, runs of one letter, long words."""
    import random
    rng = random.Random(2)
    pool = [bpe.CHAR_ID[c] for c in "abcd"]
    string = dict(zip(pool, "abcd"))
    ids = {s: i for i, s in string.items()}
    merges, seen = [], set()
    while len(merges) < 200:
        a, b = rng.choice(pool), rng.choice(pool)
        s = string[a] + string[b]
        if (a, b) in seen or len(s) > 6:
            continue
        seen.add((a, b))
        if s not in ids:
            ids[s] = 267 + len(ids)
            string[ids[s]] = s
            pool.append(ids[s])
        merges.append({"rank": len(merges), "left": a, "right": b, "id": ids[s]})
    assert len({m["id"] for m in merges}) < len(merges)
    ranks = bpe._Ranks(merges)
    words = ["".join(rng.choice("abcdXé") for _ in range(rng.randrange(1, 90))) for _ in range(2000)] + ["a" * 30, "ab" * 31, "X"]
    assert bpe._encode_words(words, ranks) == [bpe._encode_word(w, ranks.table) for w in words]
    assert bpe._encode_words([], ranks) == [] and bpe._encode_words(["ab"], bpe._Ranks([])) == [[bpe.CHAR_ID["a"], bpe.CHAR_ID["b"]]]


def test_rounds_over_segments(spark, monkeypatch):
    """Words far beyond the budget of a round: few rounds, as their distinct segments fit, and the
    library's merges."""
    import random
    rng = random.Random(4)
    syllables = [a + b for a in "bcdfghjklm" for b in "aeiou"] + ["an", "str", "oo"]
    text = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 7))) for _ in range(500)) for _ in range(12)]
    replays = []
    replay = bpe._replay
    monkeypatch.setattr(bpe, "_replay", lambda *a, **k: replays.append((len(a[0].sym), k.get("once"))) or replay(*a, **k))
    size = 267 + 500
    vocab, merges = bpe.learn_bpe(spark, spark.createDataFrame([(t,) for t in text], "text string"), vocab_size=size, round_symbols=9000)
    v = {r["id"]: r["token"] for r in vocab.collect()}
    model = json.loads(hf_tokenizer(text, size).to_str())["model"]
    hf_merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    assert [(v[r["left"]], v[r["right"]]) for r in merges.orderBy("rank").collect()] == hf_merges
    assert any(once for _, once in replays) and max(n for n, _ in replays) <= 9000
    assert bpe.learn_bpe.last_rounds <= 8


def test_merges_inside_of_segments(spark):
    """Cutting at pairs that no merge joins changes nothing."""
    import numpy as np
    words = spark.createDataFrame([([1, 2, 1, 2, 3], 5), ([1, 1, 1], 2), ([3, 2], 7), ([2, 1, 2, 3, 1, 2], 1), ([4, 1, 2, 4, 1, 2, 3], 1)],
                                  "s array<int>, f long").withColumn("l", F.size("s").cast("long"))
    merges = [(1, 2, 9), (9, 3, 10)]
    rows = lambda df: sorted(map(repr, df.collect()))
    codes = np.sort(np.array([bpe._code(1, 2), bpe._code(2, 3)]))
    assert rows(bpe._merge_words(spark, words, merges, codes)) == rows(bpe._merge_words(spark, words, merges))
    counts = {tuple(np.frombuffer(r["g"], np.int32).tolist()): r["f"] for r in bpe._segment_counts(words, codes).collect()}
    assert counts == {(1, 2): 5 + 1 + 1, (1, 2, 3): 5 + 1 + 1}

"""Golden micro-cases for cleaning, windows, step split and chunks."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from qaframe import constants as C
from qaframe.functions import text as X
from qaframe.operators import chunking


def one(spark, col_expr, value, name="x"):
    df = spark.createDataFrame([(value,)], f"{name} string")
    return df.select(col_expr.alias("r")).first()["r"]


def test_clean_text(spark):
    cases = [
        (None, ""), ("", ""),
        ("a   b $x   y$  c", "a b $x   y$ c"),
        ("$$x   y$$  z", "$$x y$$ z"),
        ("  lead  ", " lead "),
        ("a $ b   c", "a $ b c"),
        ("$a$   $b  b$  ", "$a$ $b  b$ "),
        ("x\r\n\r\n\r\n\r\ny", "x\n\ny"),
        ("\t\t x   y", "\t\t x y"),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, x string")
    got = {r["i"]: r["c"] for r in df.select("i", X.clean_text("x").alias("c")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (cases[i], got[i])


def windows(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return [w["text"] for w in df.select(X.sliding_windows("t").alias("w")).first()["w"]]


def steps(spark, text):
    df = spark.createDataFrame([(1, text)], "sample_id long, response string")
    return [r["step"] for r in chunking.final_steps(df).orderBy("step_idx").collect()]


def test_window_lengths_and_merge(spark):
    table = {100: ([100], 1), 176: ([176], 1), 177: ([177, 1], 1), 205: ([205, 29], 1),
             206: ([206, 30], 2), 256: ([256, 80], 2), 300: ([256, 124], 2)}
    for n, (lens, n_steps) in table.items():
        assert [len(w) for w in windows(spark, "a" * n)] == lens, n
        st = steps(spark, "a" * n)
        assert len(st) == n_steps, n
    assert len(steps(spark, "a" * 177)[0]) == 179


def test_sentence_cut(spark):
    assert [len(w) for w in windows(spark, "a" * 130 + ". " + "b" * 200)] == [131, 256, 105]
    assert [len(w) for w in windows(spark, "a" * 128 + ". " + "b" * 200)] == [256, 154]


def all_windows(text, size=C.WINDOW, overlap=C.OVERLAP):
    """By definition: the last allowed cut of every window, from a list of all of them."""
    ends = [i for i in range(len(text)) if text[i:i + 2] in C.SENTENCE_ENDS]
    start = 0
    while start < len(text):
        allowed = [i for i in ends if start + size // 2 < i <= start + size - 2] if start + size < len(text) else []
        stop = allowed[-1] + 1 if allowed else start + size
        yield start, text[start:stop]
        start = stop - overlap


def test_windows_of_many_texts(spark):
    rng = random.Random(5)
    texts = [None, "", ".", ". ", "a. " * 200] + [
        "".join(rng.choice(["a", "é", "𝒳", ". ", "!", " ", ".\n", "word "]) for _ in range(rng.randrange(900))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    rows = {r["i"]: r["w"] for r in df.select("i", X.sliding_windows("t", 60, 13).alias("w")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else list(all_windows(t, 60, 13))
        assert (rows[i] if rows[i] is None else [(w["start"], w["text"]) for w in rows[i]]) == want
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "sample_id long, response string").repartition(3)
    got = {}
    for r in chunking.final_steps(table).collect():
        got.setdefault(r["sample_id"], {})[r["step_idx"]] = r["step"]
    for i, t in enumerate(texts):
        if t:                                            # no step markers here: the windows, short ones glued
            parts = [w.strip() for _, w in all_windows(t)]
            heads = [k for k, p in enumerate(parts) if k == 0 or len(p) >= C.MIN_PART] + [len(parts)]
            assert [got[i][k] for k in range(len(got[i]))] == [" ".join(parts[a:b]) for a, b in zip(heads, heads[1:])]


def test_windows_are_linear():
    """Twice the text, about twice the time."""
    text = "some words here and there. " * 40_000
    times = []
    for t in (text, text * 2):
        best = []
        for _ in range(3):
            t0 = time.perf_counter()
            at, lo, hi = X.window_bounds([t], C.WINDOW, C.OVERLAP)
            best.append(time.perf_counter() - t0)
        assert hi[-1] == len(t) and (np.diff(lo) > 0).all()
        times.append(min(best))
    assert times[1] < 4 * times[0]


def test_step_split(spark):
    r = "Bước 1: tính tổng hai số đã cho\nBước 2: kết luận là mười hai ok nhé\nVậy x"
    assert steps(spark, r) == ["Bước 1: tính tổng hai số đã cho",
                               "Bước 2: kết luận là mười hai ok nhé Vậy x"]
    assert steps(spark, "x\n1.\nVậy y") == ["x 1. Vậy y"]
    assert steps(spark, "   ") == [""]
    assert steps(spark, "") == []
    assert steps(spark, None) == []


def chunk_rows(spark, q, r):
    df = spark.createDataFrame([(7, q, r, "t")], "sample_id long, query string, response string, math_type string")
    return chunking.chunk_samples(df).orderBy("chunk_pos").collect()


def test_full_chunk_cap(spark):
    q = "q"
    r512 = "r" * (512 - len("[FULL] q | "))
    full = [c for c in chunk_rows(spark, q, r512) if c["chunk_type"] == "full"][0]
    assert len(full["text"]) == 512 and not full["text"].endswith("...")
    full = [c for c in chunk_rows(spark, q, r512 + "r") if c["chunk_type"] == "full"][0]
    assert len(full["text"]) == 512 and full["text"].endswith("...")


def test_null_rules(spark):
    assert chunk_rows(spark, None, None) == []
    assert [c["chunk_type"] for c in chunk_rows(spark, "q", None)] == ["question"]
    rows = chunk_rows(spark, "", "r" * 40)
    assert [c["chunk_type"] for c in rows] == ["solution"] and rows[0]["query_ref"] == ""
    rows = chunk_rows(spark, "q", "r" * 40)
    assert [c["chunk_type"] for c in rows] == ["question", "solution", "full"]
    sol = rows[1]
    assert sol["text"] == "[LỜI GIẢI - bước 1/1] " + "r" * 40 and sol["step_idx"] == 0
    assert rows[0]["text"] == "[ĐỀ BÀI] q" and rows[0]["step_idx"] is None


def test_strip_covers_python_whitespace(spark):
    s = "\x1c\u3000 a b\x1f\xa0\n"
    assert one(spark, X.strip("x"), s) == s.strip()


def test_template_check(spark):
    from qaframe.functions.text import inference_prompt
    df = spark.createDataFrame([("q",)], "q string")
    p = df.select(inference_prompt("q").alias("p")).select(X.has_template_tags("p").alias("ok")).first()["ok"]
    assert p is True
    assert one(spark, X.has_template_tags("x"), "[SYS]a[/SYS][AST]") is False


def test_math_spans(spark):
    df = spark.createDataFrame([("a $$x$$ b $y$ \\[z\\] \\(w\\)",)], "t string")
    assert df.select(X.math_spans("t").alias("m")).first()["m"] == ["$$x$$", "$y$", "\\[z\\]", "\\(w\\)"]


def test_long_texts_are_handled_in_slices(spark, monkeypatch):
    """A batch is cut into slices of bounded bytes, a null and a text beyond the bound among them;
    windows and steps are those of the whole batch."""
    import pyarrow as pa
    column = pa.array(["a" * 30, None, "b" * 30, "", "c" * 500, "d"])
    assert X.row_slices(column, 64) == [(0, 4), (4, 1), (5, 1)]
    assert X.row_slices(column.slice(2), 64) == [(0, 2), (2, 1), (3, 1)]
    assert X.row_slices(column.slice(0, 0), 64) == [(0, 0)]
    rng = random.Random(9)
    words = ["one", "two. ", "Bước 2: ", "x", "\nVậy "]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, response string").coalesce(1)

    def results():
        steps = sorted(map(tuple, chunking.final_steps(df).collect()))
        return steps, sorted(map(tuple, chunking.text_windows(df, "sample_id", "response").collect()))
    whole = results()
    cut = X.row_slices                        # pickled with the UDF by value: workers see it
    monkeypatch.setattr(X, "row_slices", lambda column: cut(column, 2000))
    assert results() == whole and len(whole[0]) > 60


def test_batches_are_bounded_in_bytes(spark):
    """Where the session says nothing, an Arrow batch holds 16 MB at most."""
    from qaframe.session import BATCH_BYTES, bound_batches
    spark.conf.unset(BATCH_BYTES)
    bound_batches(spark)
    assert int(spark.conf.get(BATCH_BYTES)) == 16 * 1024 * 1024

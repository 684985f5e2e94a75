"""Operators 1, 5 and 6 against direct loops, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from qaframe.llm.line_dedup import LineRuns, line_dedup, line_hashes, ordered_scans
from qaframe.llm.quality import QualityRules, _repeats, quality
from qaframe.llm.sharding import shard_by_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRIP = " \t\n\x0b\x0c\r"


def prose(rng, n):
    words = ["river", "stone", "Été", "wander", "light", "grau", "ñandú", "of", "the", "quiet", "日本", "x"]
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def quality_rows():
    rng = random.Random(5)
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (4, "a b a b a b a b " * 20),
            (5, "\n".join(prose(rng, 30) for _ in range(6))), (5, "\n".join(prose(rng, 30) for _ in range(6))),
            (6, prose(rng, 40) + "\n" + prose(rng, 40) + "\nHome | About | Contact | Login | Shop\nAll rights reserved."),
            (7, " ".join(f"w{i}###" for i in range(200))), (8, " ".join(f"W{i}X!!" for i in range(120))),
            (9, " | ".join(f"item{i}" for i in range(90))), (None, " ".join(f"v{i}" for i in range(60)) + "."),
            (10, " ".join(f"v{i}" for i in range(30_000)) + ".\n" + " ".join(f"v{i}" for i in range(30_000)) + "."),
            (11, "x" * 200_000), (12, "\x0b\x0cfeed\x0bx\r\n" * 30)]


def test_quality_counts_and_verdicts(make_docs):
    rows = quality_rows()
    out = quality(make_docs(rows, clashes=True)).collect()
    assert len(out) == len(rows)
    want = collections.Counter((i, *base_counts(t)) for i, t in rows)
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                                        r.n_repeat_words, r.base_failed) for r in out)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in (5, 6, None)) and not any(kept[i] for i in (0, 1, 2, 3, 4, 7, 8, 9, 11))
    cleaned = {r.doc_id: r.cleaned for r in out}
    assert "Home |" not in cleaned[6] and "rights" not in cleaned[6] and cleaned[6].count("\n") == 1
    assert cleaned[0] == "" and cleaned[5] == dict(rows)[5]


def test_quality_filter_and_empty(make_docs):
    assert quality(make_docs([])).count() == 0
    rows = quality_rows()
    assert quality(make_docs(rows)).where("kept").count() == sum(r.kept for r in quality(make_docs(rows)).collect())


def test_repeated_windows_random(make_docs):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    out = {r.doc_id: r.n_repeat_words for r in quality(make_docs(rows)).collect()}
    assert out == {i: base_counts(t)[4] for i, t in rows}


def test_fragments_are_short(make_docs):
    rng = random.Random(13)
    clean = prose(rng, 60)
    kept = ["静かな川の石と光が谷を渡り遠い山へ続いていた" * 3 + "、", "แม่น้ำเงียบสงบไหลผ่านหุบเขา" * 4, "one\ttwo\tthree\tfour",
            "river" * 20, "one two three four"]
    gone = ["Shop now", "one  two   three", "静かな川"]
    rows = [(i, clean + "\n" + x) for i, x in enumerate(kept + gone)]
    out = {r.doc_id: (r.n_failed_lines, r.cleaned) for r in quality(make_docs(rows)).collect()}
    assert out == {i: (0, t) if i < len(kept) else (1, clean) for i, t in rows}


def test_repeats_with_shared_upper_bits(spark):
    """Window hashes that differ in the lower bits only, in turn."""
    a, b, c = (5 << 32) + 1, (5 << 32) + 2, -7
    rows = [(0, [a, b, a]), (1, [b, a, c, c, b, c, a, a]), (2, [a, b, c]), (3, [a, c, a]), (4, [])]
    out = _repeats(spark.createDataFrame(rows, "id int, grams array<bigint>")).collect()
    assert {r.id: r.n_repeat_words for r in out} == {0: 5, 1: 10, 2: 0, 3: 5, 4: 0}


def test_notices_of_any_length(make_docs):
    rng = random.Random(7)
    notice = prose(rng, 60) + " We USE cookies. " + prose(rng, 60)
    clean = prose(rng, 200)
    rows = [(0, clean + "\n" + notice), (1, notice), (2, clean + "\n" + clean[::-1] + "."),
            (3, "# a mark\n" + notice + "\n" + clean), (4, clean + "\nAll rights\nreserved by the river and stone.")]
    assert len(notice) > 300
    out = {r.doc_id: r for r in quality(make_docs(rows)).collect()}
    assert {i: (r.n_failed_lines, r.kept) for i, r in out.items()} == {
        0: (1, True), 1: (1, False), 2: (0, True), 3: (2, True), 4: (1, True)}
    assert out[0].cleaned == clean and out[1].cleaned == "" and out[1].kept_percent == 0


def test_quality_is_native(make_docs):
    plan = quality(make_docs(quality_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan.split("== Physical Plan ==")[1])


def line_key(line):
    return line.strip(STRIP).translate(LOWER)


def lines_by_loop(rows, min_chars=20, min_docs=3):
    """Every row is a document; a null id is the smallest."""
    order = lambda i: (i is not None, i or 0)
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            held[k].append(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(line_key(x)) < min_chars or len(held[line_key(x)]) < min_docs
                or max(held[line_key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return collections.Counter(out)


def line_rows():
    rng = random.Random(3)
    pool = [prose(rng, 8) for _ in range(12)] + ["short", "", "   ", "A" * 20, "b" * 19]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", " "])
                          for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, pool[0]), (None, pool[1] + "\n" + pool[0]), (59, rows[59][1]), (59, pool[2]),
             (62, pool[0].upper() + "\n" + pool[0]), (63, ("long line number one of many\n" * 3000) + pool[3])]
    return rows


def test_line_dedup(make_docs):
    rows = line_rows()
    for batches, fanout in ((4, 3), (1, 3), (5, 2)):
        out = line_dedup(make_docs(rows, clashes=True), batches=batches, fanout=fanout).collect()
        assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out) == lines_by_loop(rows)


def test_line_dedup_empty_and_carry(make_docs):
    assert line_dedup(make_docs([])).count() == 0
    out = line_dedup(make_docs([(1, "a\nb")]), carry=["lang", "n_chars"]).first()
    assert (out.carried.lang, out.carried.n_chars, out.kept_text) == ("en", 3, "a\nb")


def test_line_runs_are_levelled(make_docs, spark, tmp_path):
    rows = line_rows()
    hashes = line_hashes(make_docs(rows), "doc_id", "text", 20).cache()
    runs = LineRuns(spark, f"{tmp_path}/runs", fanout=2)
    fresh = []
    for b in range(5):
        run = runs.add(hashes.where(F.pmod("d", F.lit(5)) == b))
        fresh += [(r.h1, r.h2) for r in run.where("fresh").collect()]
    assert len(fresh) == len(set(fresh)) == hashes.select("h1", "h2").distinct().count()   # each hash is new once
    assert len(runs.levels) >= 3 and all(len(level) < 2 for level in runs.levels)
    assert runs.totals().agg(F.sum("n_docs")).first()[0] == hashes.where("first").count()


def test_runs_are_joined_as_they_are(make_docs, spark, tmp_path):
    """Neither the anti joins of a batch nor the merge of two runs shuffles or sorts a run again."""
    hashes = line_hashes(make_docs(line_rows()), "doc_id", "text", 20).cache()
    runs = LineRuns(spark, f"{tmp_path}/runs", fanout=9)
    for b in range(3):
        runs.add(hashes.where(F.pmod("d", F.lit(3)) == b))
    batch = runs._store(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("d").alias("max_doc")))
    with ordered_scans(spark):
        for frame, joins in ((runs.unseen(batch), 3), (runs._merged(runs.runs()[:2]), 1)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == joins and "Exchange" not in plan and "Sort [" not in plan
        assert runs.unseen(batch).count() == 0
    names = list(runs.tables)
    runs.forget()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_line_totals_follow_the_anti_join(make_docs, spark, tmp_path, monkeypatch):
    """A hash is listed by the row that brought it in as new; without the anti-join
    every batch brings its hashes in, and the totals show it."""
    hashes = line_hashes(make_docs(line_rows()), "doc_id", "text", 20).cache()

    def totals(name):
        runs = LineRuns(spark, f"{tmp_path}/{name}", fanout=9)
        for b in range(3):
            runs.add(hashes.where(F.pmod("d", F.lit(3)) == b))
        return collections.Counter(tuple(r) for r in runs.totals().collect())
    want = hashes.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")), F.max("d"))
    assert totals("runs") == collections.Counter(tuple(r) for r in want.collect())
    join = type(hashes).join
    monkeypatch.setattr(type(hashes), "join", lambda self, other, on=None, how=None: self if how == "left_anti"
                        else join(self, other, on, how))
    assert sum(totals("without").values()) > want.count()


def test_shards(make_docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(500)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (7, "other"), (None, "no id"), (502, "y" * 9000)]
    out = shard_by_bytes(make_docs(rows, clashes=True), shards=24).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    last = (False, -1)
    for s in sorted(by):
        part = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in part]
        assert ids == sorted(ids) and last <= ids[0]           # contiguous in id order
        last = ids[-1]
        assert abs(sum(r.size for r in part) - total / 24) <= largest


def test_shards_empty_and_tiny(make_docs):
    assert shard_by_bytes(make_docs([])).count() == 0
    out = shard_by_bytes(make_docs([(1, "a"), (2, "b")]), shards=24).collect()
    assert {r.slot for r in out} == {0}


def test_queries_digest(spark):
    from qaframe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {k[0]: (k[1], k[2], hashlib.sha256(k[3].encode()).hexdigest()) for k in lines_by_loop(list(docs.items()))}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert got == want
    got = {r.doc_id: tuple(r)[1:7] for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    assert got == {i: base_counts(t) for i, t in docs.items()}
    assert QUERIES["op5_sharding"](spark, sf).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]

"""Operators 7 and 9, with nulls, hot values, ties and damaged files."""

import collections
import hashlib
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from qaframe.llm.files import RangeReader
from qaframe.llm.queries import URL_RULES
from qaframe.llm.urls import bloom_blocks, canonical, judge_urls
from qaframe.llm.warc import INDEX_MEMBER, WARC_MEMBER, WarcPackage, ZipPackage, read_packages, write_packages

URLS = [None, "", "no scheme", "http://", "http:///path", "HTTP://WWW.Example.ORG/es/x?a#b", "https://a.b.example.org/en/12",
        "https://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/DE/1",
        "http://x.com", "http://org/", "http://org", "http://y.net:80/p/?utm_source=q&b=2&a=1#z", "https://www.y.net/p?a=1&b=2",
        "http://y.net/p//", "http://y.net/p", "ftp://a?b://c/d", "http://É.org/ü", "http://y.net/p?ref", "x://h/p\nq?r"]


def parts(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def canon(url):
    host, path = parts(url)
    host = re.sub(":(80|443)?$", "", re.sub(r"^www\.", "", host))
    if not host:
        return None
    m = re.match(r".*?://[^?#]*\?([^#]*)", url, re.S)
    query = sorted(p for p in (m[1] if m else "").split("&")
                   if p and not re.match("(utm_[^=]*|ref|fbclid|gclid|msclkid)(=|$)", p))
    return host + re.sub("/+$", "", path) + ("?" + "&".join(query) if query else "")


def judged(url, listed):
    host, path = parts(url)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name)) if fit else None
    c = canon(url)
    hit = best is None and c is not None and c in {canon(x) for x in listed}
    return host, path, best and best.name, best.verdict if best else ("block" if hit else "allow"), c


def pages(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for name in ("id", "host", "path", "canon", "rule", "block", "h", "w0", "possible", "listed"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_very_long_urls(spark):
    """URLs of megabytes are judged whole; the list is then too large in bytes for a broadcast of many."""
    long = "http://long.net/" + "p/" * 600_000 + "?b=" + "x" * 300_000 + "&a=1#" + "f" * 1000
    urls = [long, long.replace("&a=1", "&a=2"), "http://a." + "b." * 20_000 + "org/en", "x" * 500_000, "http://example.org/en/1" + "0" * 300_000]
    out = judge_urls(pages(spark, urls), spark.createDataFrame([(long + "y",), ("http://q.net/",)], "url string"), URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.canonical_url) for r in out} == {
        i: judged(u, [long + "y"]) for i, u in enumerate(urls)}


def test_urls(spark):
    urls = URLS + URLS + ["http://hot.net/a"] * 300 + [f"http://n{i}.net/{i}" for i in range(300)]
    listed = ["https://www.y.net/p/?b=2&a=1", "http://hot.net/a#x", None, "bad", "http://n7.net/7?utm_x=1", "http://x.com/fr/1"]
    out = judge_urls(pages(spark, urls), spark.createDataFrame([(x,) for x in listed], "url string"), URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.canonical_url) for r in out}
    assert len(out) == len(urls) and got == {i: judged(u, listed) for i, u in enumerate(urls)}
    assert all(r.possible for r in out if r.listed)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "url string")
    assert judge_urls(pages(spark, URLS).limit(0), none, URL_RULES).count() == 0
    out = judge_urls(pages(spark, URLS), none, []).collect()
    assert {r.verdict for r in out} == {"allow"} and len(out) == len(URLS)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    def urls(lo):
        return spark.range(lo, lo + 4000).select(canonical(F.concat(F.lit("http://n.net/"), F.col("id"))).alias("canon"))
    from qaframe.llm.urls import _bits
    blocks = bloom_blocks(urls(0), 250).cache()

    def passed(keys):
        k = keys.select(F.pmod(F.xxhash64("canon"), F.lit(250)).alias("block"), F.xxhash64(F.lit("bits"), F.col("canon")).alias("h"))
        hit = F.lit(True)
        for i, b in enumerate(_bits("h")):
            hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
        return k.join(blocks, "block").where(hit).count()
    assert passed(urls(0)) == 4000
    assert passed(urls(10_000)) < 200


BIG = "<html>" + "déjà vu " * 40 + "</html>"
PAGES = [(1, "http://a.net/1", BIG), (2, "http://a.net/2", BIG), (2, "http://a.net/2b", BIG), (0, None, "<p>tiny</p>"),
         (9, "u", "<p>tiny</p>"), (3, "http://a.net/\r\nx", None), (4, "", ""), (None, "n", BIG), (None, "n", BIG),
         (5, "http://a.net/5", "x" * 100), (6, "http://a.net/6", "x" * 100), (7, "z", "x" * 99), (8, "z", "x" * 99),
         (10, "http://a.net/long", "long \r\n\r\n WARC/1.1 PK\x05\x06 " * 40_000), (11, "é", "y" * 101), (11, "é", "y" * 101)]


def records_by_loop(rows):
    body = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if i is not None and len(body(h)) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        again = i is not None and h in first and first[h] != i
        out.append((i, len(body(h)), hashlib.sha256(body(h)).hexdigest(), "revisit" if again else "response",
                    first[h] if again else None))
    return collections.Counter(out)


def page_rows(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("id", "digest", "refers_to", "n", "payload"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_warc(spark, tmp_path, monkeypatch):
    import qaframe.llm.warc as W
    for bound in (10**6, 0):                                   # broadcast and shuffled revisits
        monkeypatch.setattr(W, "BROADCAST_REVISITS", bound)
        folder = f"file://{tmp_path}/p{bound}"
        manifest = write_packages(page_rows(spark, PAGES * 3), folder=folder, package_bytes=3000)
        out = read_packages(manifest).collect()
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                                   for r in out) == records_by_loop(PAGES * 3)
        assert all((bytes(r.payload) if r.payload is not None else None) is not None
                   and len(r.payload) == r.payload_bytes for r in out if r.record_type == "response")
        assert {r.url for r in out if r.page_id == 1} == {"http://a.net/1"} and {r.url for r in out if r.page_id == 0} == {None}
        assert manifest.agg(F.sum("n_records")).first()[0] == len(out) and manifest.count() > 3


def test_packages_are_plain_zip_and_range_read(spark, tmp_path):
    m = write_packages(page_rows(spark, PAGES).coalesce(1), folder=f"file://{tmp_path}/z").first()
    with zipfile.ZipFile(m.path.removeprefix("file://")) as z:
        assert z.testzip() is None and z.namelist() == [WARC_MEMBER, INDEX_MEMBER]
        raw = z.read(WARC_MEMBER)
    package = WarcPackage(m.path)
    entries = list(package.index(block=64))
    assert raw.count(b"WARC-Record-ID: ") >= len(entries) == m.n_records
    before = package.r.bytes_read
    one = package.record(entries[-1]["offset"], entries[-1]["length"])
    assert one["id"] == entries[-1]["id"] and package.r.bytes_read - before == entries[-1]["length"]


def test_empty_packages(spark, tmp_path):
    manifest = write_packages(page_rows(spark, PAGES).limit(0), folder=f"file://{tmp_path}/e")
    assert manifest.count() == 0 and read_packages(manifest).count() == 0


def test_zip64_directory(tmp_path):
    """More members than the plain end record can count."""
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"")
        with z.open(zipfile.ZipInfo("last"), "w", force_zip64=True) as f:
            f.write(b"found")
        z.comment = b"a comment PK\x05\x06 with a false end"
    reader = RangeReader(f"file://{path}")
    package = ZipPackage(reader)
    assert len(package.members) == 66_001
    assert reader.read(*package.locate("last")) == b"found"


def test_damage_is_reported(spark, tmp_path):
    m = write_packages(page_rows(spark, PAGES).coalesce(1), folder=f"file://{tmp_path}/d").first()
    file = m.path.removeprefix("file://")
    data = open(file, "rb").read()
    open(file, "wb").write(data.replace("déjà".encode(), "dejA".encode() + b"xx", 1))
    with pytest.raises(ValueError):
        list(WarcPackage(m.path).records())
    open(file, "wb").write(data[:-30])
    with pytest.raises(ValueError):
        WarcPackage(m.path)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(WARC_MEMBER, b"x" * 100)
    open(file, "wb").write(buffer.getvalue())
    with pytest.raises(ValueError):
        WarcPackage(m.path)


def test_page_queries(spark):
    from qaframe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic == 1}
    listed = [u for i, u, _ in rows if i in toxic]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.canonical_url) for r in QUERIES["op7_url_filters"](spark, sf).collect()}
    assert got == {i: judged(u, listed) for i, u, _ in rows}
    out = QUERIES["op9_warc"](spark, sf).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                               for r in out) == records_by_loop(rows)

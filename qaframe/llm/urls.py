"""URL rules and a listed-URL filter (operator 7), DataFrame operations only.

A URL is judged by the longest rule (host and path prefix) that fits it.  URLs
without a rule are blocked when their canonical form is listed: a blocked Bloom
filter of the listed URLs lets possible hits pass, and an exact hash join with
the list removes the false positives.

The filter is a table of 256-bit blocks (four longs).  A listed URL sets one bit
in each long of the one block that its hash names, so building it is a partial
aggregation and probing it is an equi-join on the block number.  It is broadcast
only when its size, known from the list's count, is small; else it is joined by
a shuffle.

Canonical form: host without `www.` and default port, path without trailing
slashes, query without tracking parameters and sorted, no scheme or fragment.

Defined results: a null URL, or one without `://`, has empty host and path, fits
no rule and is never listed: allowed.  Rows are judged one by one, so repeated rows and
null ids get a verdict each; of rules that fit, the longest wins, and of equal ones
there is one only.  URLs are read whole, however long.  An empty table gives an empty
result, an empty list blocks nothing.  Only the id and URL columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaframe.llm.common import ascii_lower, stage, workdir

TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|msclkid)(=|$)"
KEYS_PER_BLOCK = 16                  # 16 bits per listed URL
BROADCAST_BLOCKS = 500_000           # 48 bytes each
BROADCAST_BYTES = 32 << 20           # of listed URLs


@dataclass(frozen=True)
class UrlRule:
    verdict: str                     # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(url_host(url), "^www\\.", ""), ":(80|443)?$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, F.regexp_replace(url_path(url), "/+$", ""),
                                       F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))
                                              ).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits; nulls without one."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _bits(h: Column) -> list[Column]:
    """The bit that a hash sets in each of the four longs of its block."""
    return [F.expr(f"shiftleft(1L, cast(pmod(shiftright({h}, {6 * i}), 64) as int))") for i in range(4)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the blocked Bloom filter over the column `canon`."""
    hashed = keys.select(F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block"),
                         F.xxhash64(F.lit("bits"), F.col("canon")).alias("h"))
    bits = hashed.select("block", *[b.alias(f"w{i}") for i, b in enumerate(_bits("h"))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id",
               url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, canonical_url, possible, listed."""
    spark = pages.sparkSession
    path = workdir(spark, "urls")
    keys = stage(listed.select(canonical(F.col(listed_col)).alias("canon")).where("canon is not null").distinct(),
                 f"{path}/listed")
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("canon")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // KEYS_PER_BLOCK))
    blocks = bloom_blocks(keys, n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    u = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", url_host(u).alias("host"), url_path(u).alias("path"), canonical(u).alias("canon"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict)
    # URLs under a rule, and those without a canonical form, need no probe
    asked = rows.where("rule is null and canon is not null").withColumn(
        "block", F.pmod(F.xxhash64("canon"), F.lit(n_blocks))).withColumn("h", F.xxhash64(F.lit("bits"), F.col("canon")))
    possible = F.lit(True)
    for i, b in enumerate(_bits("h")):
        possible = possible & (F.col(f"w{i}").bitwiseAND(b) != 0)
    probed = asked.join(blocks, "block", "left").select(
        "id", "host", "path", "canon", "rule", "ruled", F.coalesce(possible, F.lit(False)).alias("possible"))
    probed = stage(probed.unionByName(rows.where("rule is not null or canon is null").withColumn("possible", F.lit(False))),
                   f"{path}/probed")
    hits = probed.where("possible")
    small = size["n"] * 32 + size["bytes"] <= BROADCAST_BYTES
    right = F.broadcast(keys) if small else keys
    judged = (probed.where(~F.col("possible")).withColumn("listed", F.lit(False))
              .unionByName(hits.join(right, "canon", "left_semi").withColumn("listed", F.lit(True)))
              .unionByName(hits.join(right, "canon", "left_anti").withColumn("listed", F.lit(False))))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        F.col("canon").alias("canonical_url"), "possible", "listed")

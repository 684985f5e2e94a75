"""MinHash near-duplicate groups (operator 4).

1. One pass computes every document's shingle set (never stored), its key, its
   minima and its band keys.  Documents with equal sets form one class, named by
   its smallest id; only classes go on.
2. Classes that share a band key are candidates.  A band bucket is never
   expanded into its pairs: every member is compared with the bucket's hub, the
   member that shares most buckets, and again with a second hub for members that
   are not yet connected.
3. What is still not connected inside a bucket is compared exhaustively, in tiles
   of bounded blocks and only across components: each member outside the largest
   component with all of the others, by signatures first, each pair in the first band
   that it shares, and the members of agreeing pairs by their full sets in a second
   pass.  A tile emits at most one link for every two components that it joins, never
   its pairs.  So no link between candidates is lost, and a bucket of k connected
   members costs k comparisons.
4. A pair compared with a hub is first verified by its signatures (agreement far
   below the threshold ends it), then confirmed on the full shingle sets.
5. Confirmed links are closed by alternating large-star and small-star.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing.  A row with a null id is linked with nothing, its
component is null and it is kept.  Rows that share an id are one document, linked
by any of its texts; repeated rows are equal classes.  Ties of the component's name
go to the smallest id.  Texts are shingled whole, however long.  An empty table gives
an empty result.  Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.common import shuffle_width, stage, workdir
from qaframe.llm.components import components
from qaframe.llm.shingles import Bands, set_keys, shingle_sets, signatures
from qaframe.llm.tokens import text_slices

SIGNED = "id long, n long, s1 long, s2 long, bands array<long>, sig array<int>"
BROADCAST_IDS = 2_000_000      # 16 bytes each; more ids than that are joined by a shuffle
TILE = 1024                     # members, and
TILE_SHINGLES = 500_000        # shingles of a block


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _signer(k: int, b: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, texts in text_slices(batch.column(1), 2_000_000):
                hashes, offsets = shingle_sets(texts, k)
                n = np.diff(offsets)
                s1, s2 = set_keys(hashes, offsets)
                minima, keys = signatures(hashes, offsets, b)
                filled = (n > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)),
                     pa.array(s2.view(np.int64)),
                     _lists(keys.view(np.int64).ravel(), filled * b.bands, pa.int64()),
                     _lists(minima.view(np.int32).ravel(), filled * b.hashes, pa.int32())],
                    names=["id", "n", "s1", "s2", "bands", "sig"])
    return run


def _shingler(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, texts in text_slices(batch.column(1), 2_000_000):
                hashes, offsets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(texts)), _lists(hashes.view(np.int64), np.diff(offsets), pa.int64())],
                    names=["id", "shingles"])
    return run


def _only_ids(rows: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows of these ids: by broadcast if their number is small enough."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Verifier:
    """Compares pairs (a, b) of classes: signatures first, then full sets."""

    def __init__(self, sigs: DataFrame, sets: DataFrame, percent: int, b: Bands):
        self.sigs, self.sets, self.percent = sigs, sets, percent
        # five standard deviations of the estimate below the threshold
        p = percent / 100
        self.least = max(0, int(b.hashes * p - 5 * (b.hashes * p * (1 - p)) ** 0.5))

    def links(self, pairs: DataFrame) -> DataFrame:
        s = self.sigs
        agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
        likely = (pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
                  .join(s.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
                  .where(agree >= self.least).select("a", "b").distinct())
        t = self.sets
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - F.col("both")
        return (likely.join(t.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
                .join(t.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
                .withColumn("both", both).where(100 * F.col("both") >= self.percent * union)
                .select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


TILE_ROW = "key long, i int, j int, side int, id long, comp long, minor boolean"


def _targets(comp: np.ndarray, ids: np.ndarray, minor: np.ndarray, side: np.ndarray, m: int) -> np.ndarray:
    """Members that the probe in row m is compared with: those of other components; of
    two minors the one with the smaller id is the member."""
    return np.flatnonzero((side == 0) & (comp != comp[m]) & (~minor | (ids < ids[m])))


def _agreeing(least: int, b: Bands):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        """Members and probes of pairs that share this band first and whose signatures agree."""
        cols = [tile[c].to_numpy() for c in ("comp", "id", "minor", "side")]
        band = int(tile["band"].iloc[0])
        sigs = np.stack(tile["sig"].to_numpy())
        involved = np.zeros(len(tile), dtype=bool)
        for m in np.flatnonzero(cols[3] == 1):
            at = _targets(*cols, m)
            same = sigs[at] == sigs[m]
            near = same.sum(axis=1) >= least
            if near.any():
                at, same = at[near], same[near].reshape(-1, b.bands, b.rows)
                at = at[~same[:, :band].all(axis=2).any(axis=1)]
                if len(at):
                    involved[at] = True
                    involved[m] = True
        return tile.loc[involved, ["key", "i", "j", "side", "id", "comp", "minor"]]
    return run


def _linking(percent: int):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        """Links between components by exact comparison of full sets."""
        comp, ids, minor, side = cols = [tile[c].to_numpy() for c in ("comp", "id", "minor", "side")]
        sets = list(tile["shingles"])
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[shingle] > 1
        owner, shingle = owner[shared], shingle[shared]
        order = np.argsort(shingle, kind="stable")              # postings: owners by shingle
        postings = owner[order]
        start = np.concatenate(([0], np.cumsum(np.bincount(shingle, minlength=len(df)))))
        mine = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for m in np.flatnonzero(side == 1):
            own = shingle[mine[m]:mine[m + 1]]
            lo, size = start[own], start[own + 1] - start[own]
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            both = np.bincount(postings[at], minlength=len(sets))
            x = _targets(*cols, m)
            x = x[100 * both[x] >= percent * (n[m] + n[x] - both[x])]
            for c, first in zip(*np.unique(comp[x], return_index=True)):
                if find(int(c)) != find(int(comp[m])):
                    root[find(int(c))] = find(int(comp[m]))
                    out.append((int(ids[m]), int(ids[x[first]])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _tiles(live: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, dealt to tiles.

    Every pair of different components has a minor: a member outside the bucket's
    largest component.  A tile compares a block of members (side 0) with a block of
    minors (side 1): members go to every block of minors, minors to every block of
    members.  So k members of which m are minors, one block of them, give
    k + m * (blocks of members) rows.  The tiles have partitions of their own, not cut
    down by their bytes, as their work is not in proportion to these."""
    def blocks(n: str, rows: str):
        return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(rows) / TILE, F.col(n) / TILE_SHINGLES))).cast("int")
    parts = live.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    sums = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("k"), F.sum("n").alias("kn"),
                                    F.max(F.struct("c", "n", (-F.col("comp")).alias("minus"))).alias("top"))
    open_buckets = sums.where("comps > 1").select(
        "key", (-F.col("top.minus")).alias("largest"), "k", "kn", (F.col("k") - F.col("top.c")).alias("m"),
        (F.col("kn") - F.col("top.n")).alias("mn")).select(
        "key", "largest", blocks("kn", "k").alias("nb"), blocks("mn", "m").alias("mb"))
    rows = live.join(open_buckets, "key").withColumn("minor", F.col("comp") != F.col("largest"))

    def deal(rows: DataFrame, side: int, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        return rows.select("key", "band", "id", "comp", "minor", F.lit(side).alias("side"),
                           F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other))
    members = deal(rows, 0, "i", "j", "nb", "mb")
    return members.unionByName(deal(rows.where("minor"), 1, "j", "i", "mb", "nb"))


def _by_tile(rows: DataFrame):
    width = 2 * shuffle_width(rows.sparkSession)
    return rows.repartition(width, "key", "i", "j").groupBy("key", "i", "j")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: Bands = Bands(),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept.  Documents are linked when
    100 * intersection >= percent * union of their shingle sets."""
    spark = docs.sparkSession
    path = workdir(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stage(rows.mapInArrow(_signer(words, bands), SIGNED), f"{path}/signed")
    sets = ["s1", "s2", "n"]
    named = signed.where("n > 0 and id is not null")
    classes = stage(named.groupBy(*sets).agg(F.min("id").alias("rep")), f"{path}/classes")

    # one signature per class; the key of its band bucket names the candidates
    sigs = named.join(classes.select(F.col("rep").alias("id"), *sets), ["id", *sets], "left_semi")
    keyed = sigs.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    live = stage(keyed.join(shared, "key"), f"{path}/live")
    degree = live.groupBy("id").agg(F.sum("c").alias("degree"))
    live = stage(live.select("key", "band", "id", "n").join(degree, "id").withColumn("comp", F.col("id")), f"{path}/ranked")
    live_ids = stage(live.select("id").distinct(), f"{path}/live-ids")
    n_live = live_ids.count()
    sigs = stage(_only_ids(sigs.select("id", "sig"), live_ids, n_live), f"{path}/sigs")
    full = stage(_only_ids(rows, live_ids, n_live).mapInArrow(_shingler(words), "id long, shingles array<long>"),
                 f"{path}/sets")
    verifier = _Verifier(sigs, full, percent, bands)

    # rows that share an id but not a text tie their classes together
    of_class = named.select("id", *sets).join(classes, sets).select("id", "rep")
    tied = of_class.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v").select("id", "u")
    links = of_class.join(tied, "id").select("u", F.col("rep").alias("v"))
    links = stage(links, f"{path}/links-tied")

    def relabel(labels: DataFrame, name: str) -> DataFrame:
        return stage(live.drop("comp").join(labels.withColumnRenamed("node", "id"), "id", "left")
                     .withColumn("comp", F.coalesce("component", "id")).drop("component"), f"{path}/{name}")

    # the hub of a bucket, then the best-connected member outside the hub's component
    tested = None
    for i in range(2):
        best = F.max(F.struct("degree", (-F.col("id")).alias("minus"), "comp")).alias("h")
        hub = live.groupBy("key").agg(best)
        if i:
            first = hub.select("key", F.col("h.comp").alias("taken"))
            hub = live.join(first, "key").where("comp <> taken").groupBy("key").agg(best)
        hub = hub.select("key", (-F.col("h.minus")).alias("hub"), F.col("h.comp").alias("hub_comp"))
        pairs = live.join(hub, "key").where("comp <> hub_comp").select(*_ordered("id", "hub")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, f"{path}/pairs-{i}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links.unionByName(stage(verifier.links(pairs), f"{path}/links-{i}"))
        live = relabel(components(links), f"comps-{i}")
    agreeing = stage(_by_tile(_tiles(live).join(sigs, "id")).applyInPandas(_agreeing(verifier.least, bands), TILE_ROW),
                     f"{path}/agreeing")
    rest = stage(_by_tile(agreeing.join(full, "id")).applyInPandas(_linking(percent), "u long, v long"), f"{path}/links-rest")
    links = links.unionByName(rest)
    labels = stage(components(links), f"{path}/labels")

    class_label = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        *sets, F.coalesce("component", "rep").alias("class_component"))
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("class_component", "id"))
    return (signed.select("id", *sets).join(class_label, sets, "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))

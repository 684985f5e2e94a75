"""Token ids as raw binary shards with a minimal perfect hash index (operator 3).

A shard file holds, one after another (all little-endian):

  header   magic, id width, rows, null rows, keys, ids, buckets, hash seed
  payload  the ids of all rows, `width` bytes each, in ascending key order
  starts   8-byte start (in ids) of every row, then the total
  index    displacement of every bucket (4 bytes), then per slot the 64-bit
           fingerprint of its key, and its first row and its number of rows (4 bytes each)

The keys themselves are not stored.  The index maps each distinct key to a slot
of its own: a key's bucket gives a displacement, key and displacement give the
slot.  A lookup reads the header, one displacement, one slot, the starts of its
rows and the payload range: constant work.  The stored fingerprint rejects keys
that the shard does not hold: it is a one-to-one mixing of the key with a seed,
so no other key has it.  `read_ids` fetches the documents it is asked for from the
shards whose key range holds them, each by its key through the index.

Shards are contiguous in key order: rows are range-partitioned and sorted, and a
partition writes as many shards as its rows need (`shard_tokens`, `shard_rows`).
A manifest, one row per shard, holds key range and counts; a running sum over it
gives every shard its global start.

Defined results: a null or empty text has the end id only.  Repeated keys are
stored row by row; the index leads to the first of them and `get` returns all
of the shard.  Rows with a null key come first and have no index entry.  Ids of 65,536
and above are written 4 bytes wide.  Equal keys are ordered by a hash of their
text.  An empty table gives no shard and an empty manifest; a very long text is a
shard of its own.  Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaframe.llm.common import shuffle_width, stage, workdir
from qaframe.llm.files import RangeReader, resolve, write_file
from qaframe.llm.tokens import ChunkEncoder, text_slices

MAGIC = b"IDSHARD1"
HEADER = struct.Struct("<8sIIIIQIQ")     # magic, width, rows, null rows, keys, ids, buckets, seed


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over key plus seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _slots(keys: np.ndarray, displacement: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Slot of each key under its bucket's displacement; a negative one names the slot itself."""
    with np.errstate(over="ignore"):
        turned = _mix(keys ^ _mix(displacement.astype(np.int64).view(np.uint64), seed), seed + 1) % np.uint64(n)
    return np.where(displacement < 0, -1 - displacement.astype(np.int64), turned.astype(np.int64))


def build_index(keys: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(displacement per bucket, slot per key, seed) for distinct 64-bit keys.

    Buckets are placed from the largest to the smallest; each tries
    displacements until its keys fall on free slots.  Buckets of one key take
    the slots that are left, directly."""
    n = len(keys)
    keys = keys.astype(np.int64).view(np.uint64)
    buckets = max(1, n // 3)
    while True:
        where = (_mix(keys, seed) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        counts = np.bincount(where, minlength=buckets)
        starts = np.concatenate(([0], np.cumsum(counts)))
        displacement = np.zeros(buckets, dtype=np.int32)
        taken = np.zeros(n, dtype=bool)
        slots = np.zeros(n, dtype=np.int64)
        ok = True
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] < 2:
                break
            own = order[starts[b]:starts[b + 1]]
            for base in range(0, 1 << 20, 64):      # 64 displacements at a time
                ds = np.arange(base, base + 64, dtype=np.int32)
                at = _slots(np.tile(keys[own], 64), np.repeat(ds, len(own)), n, seed).reshape(64, -1)
                good = ~taken[at].any(axis=1)
                if len(own) > 1:
                    by = np.sort(at, axis=1)
                    good &= (by[:, 1:] != by[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    displacement[b] = ds[hit[0]]
                    slots[own] = at[hit[0]]
                    taken[at[hit[0]]] = True
                    break
            else:
                ok = False                           # two keys that no displacement parts: another seed
                break
        if ok:
            single = np.flatnonzero(counts == 1)
            left = np.flatnonzero(~taken)
            own = order[starts[single]]
            slots[own] = left
            displacement[single] = -1 - left
            return displacement, slots, seed
        seed += 2


def fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit fingerprints; distinct keys have distinct ones, as every step of the mixing can be undone."""
    return _mix(keys.astype(np.int64).view(np.uint64), seed + 99).astype("<u8")


def shard_bytes(keys: list[int | None], rows: list[bytes], width: int) -> Iterator[bytes]:
    """The parts of a shard file; rows hold 32-bit ids, keys ascend, nulls first."""
    n = len(keys)
    nulls = sum(k is None for k in keys)
    own = np.array([0 if k is None else k for k in keys], dtype="<i8")
    starts = np.zeros(n + 1, dtype="<u8")
    np.cumsum([len(r) // 4 for r in rows], out=starts[1:])
    distinct, first, times = np.unique(own[nulls:], return_index=True, return_counts=True)
    seed, displacement = 7, np.zeros(0, dtype=np.int32)
    prints = np.zeros(len(distinct), dtype="<u8")
    to_row = np.zeros((len(distinct), 2), dtype="<u4")
    if len(distinct):
        displacement, slots, seed = build_index(distinct)
        prints[slots] = fingerprints(distinct, seed)
        to_row[slots, 0] = first + nulls
        to_row[slots, 1] = times
    yield HEADER.pack(MAGIC, width, n, nulls, len(distinct), int(starts[-1]), len(displacement), seed)
    for r in rows:
        yield np.frombuffer(r, "<u4").astype(f"<u{width}").tobytes()
    yield starts.tobytes()
    yield displacement.astype("<i4").tobytes()
    yield prints.tobytes()
    yield to_row.tobytes()


class IdShard:
    """Keyed access to one shard file by range reads."""

    def __init__(self, uri: str):
        self.f = RangeReader(uri)
        (magic, self.width, self.rows, self.nulls, self.keys, self.ids, self.buckets,
         self.seed) = HEADER.unpack(self.f.read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no id shard")
        self.at_payload = HEADER.size
        self.at_starts = self.at_payload + self.ids * self.width
        self.at_disp = self.at_starts + 8 * (self.rows + 1)
        self.at_prints = self.at_disp + 4 * self.buckets
        self.at_rows = self.at_prints + 8 * self.keys
        if self.at_rows + 8 * self.keys != self.f.size:
            raise ValueError(f"{uri}: its size does not agree with its header")

    def _array(self, at: int, dtype: str, n: int) -> np.ndarray:
        return np.frombuffer(self.f.read(at, n * np.dtype(dtype).itemsize), dtype)

    def _ids(self, start: int, end: int) -> np.ndarray:
        return self._array(self.at_payload + start * self.width, f"<u{self.width}", end - start)

    def find(self, key: int) -> tuple[int, int] | None:
        """First row of a key and its number of rows, by one displacement and one slot."""
        if not self.keys:
            return None
        k = np.array([key], dtype=np.int64)
        bucket = int(_mix(k.view(np.uint64), self.seed)[0] % np.uint64(self.buckets))
        d = self._array(self.at_disp + 4 * bucket, "<i4", 1)
        slot = int(_slots(k.view(np.uint64), d, self.keys, self.seed)[0])
        if self._array(self.at_prints + 8 * slot, "<u8", 1)[0] != fingerprints(k, self.seed)[0]:
            return None
        row, times = self._array(self.at_rows + 8 * slot, "<u4", 2)
        return int(row), int(times)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of all rows of a key in this shard (empty if there is none)."""
        found = self.find(key)
        if found is None:
            return []
        starts = self._array(self.at_starts + 8 * found[0], "<u8", found[1] + 1).astype(np.int64).tolist()
        return [self._ids(lo, hi) for lo, hi in zip(starts, starts[1:])]

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rows and numbers of rows of many keys at once; -1 and 0 where the shard has none."""
        if not self.keys or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        k = keys.astype(np.int64).view(np.uint64)
        disp = self._array(self.at_disp, "<i4", self.buckets)
        slot = _slots(k, disp[(_mix(k, self.seed) % np.uint64(self.buckets)).astype(np.int64)], self.keys, self.seed)
        good = self._array(self.at_prints, "<u8", self.keys)[slot] == fingerprints(keys, self.seed)
        rows = self._array(self.at_rows, "<u4", 2 * self.keys).reshape(-1, 2)[slot].astype(np.int64)
        return np.where(good, rows[:, 0], -1), np.where(good, rows[:, 1], 0)

    def fetch(self, keys: np.ndarray, nulls: bool = False, max_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start in the shard, ids) of every row of the keys asked for, and of
        the rows without a key if `nulls`.  The index gives every key's rows; their
        payload is read in ranges of about `max_ids` ids that join neighbouring rows."""
        asked = np.unique(np.asarray(keys, dtype=np.int64))
        first, times = self.find_all(asked)
        owner = np.repeat(np.arange(len(asked)), times)
        row = np.repeat(first, times) + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        if nulls:
            owner = np.concatenate((np.full(self.nulls, -1), owner))
            row = np.concatenate((np.arange(self.nulls), row))
        order = np.argsort(row, kind="stable")
        owner, row = owner[order], row[order]
        starts = self._array(self.at_starts, "<u8", self.rows + 1).astype(np.int64)
        lo = 0
        while lo < len(row):
            # rows lo..hi are neighbours in the file and of bounded length
            hi = lo + 1
            base = int(starts[row[lo]])
            while hi < len(row) and row[hi] == row[hi - 1] + 1 and starts[row[hi] + 1] - base <= max_ids:
                hi += 1
            block = self._ids(base, int(starts[row[hi - 1] + 1]))
            for r, o in zip(row[lo:hi].tolist(), owner[lo:hi].tolist()):
                yield None if o < 0 else int(asked[o]), int(starts[r]), block[starts[r] - base:starts[r + 1] - base]
            lo = hi

    def close(self) -> None:
        self.f.close()


MANIFEST = "part int, piece int, path string, first_key long, last_key long, n_nulls long, n_rows long, n_ids long, n_bytes long"


def _writer(tokenizer_path: str, end_id: int, folder: str, shard_tokens: int, shard_rows: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = ChunkEncoder.of(tokenizer_path)
        width = 2 if max(encoder.vocab_size - 1, end_id) < 1 << 16 else 4
        part, piece = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        rows: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, rows, held, piece
            path = f"{folder}/shard-{part:06d}-{piece:04d}.ids"
            size = write_file(path, shard_bytes(keys, rows, width))
            known = [k for k in keys if k is not None]
            out = pa.RecordBatch.from_pylist([{
                "part": part, "piece": piece, "path": path, "first_key": known[0] if known else None,
                "last_key": known[-1] if known else None, "n_nulls": len(keys) - len(known), "n_rows": len(rows), "n_ids": held, "n_bytes": size}],
                schema=pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()),
                                  ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_nulls", pa.int64()), ("n_rows", pa.int64()),
                                  ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
            keys, rows, held, piece = [], [], 0, piece + 1
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, texts in text_slices(batch.column(1), 4_000_000):
                for key, enc in zip(ids[lo:lo + len(texts)], encoder.encode(texts)):
                    keys.append(key)
                    rows.append(enc + end)
                    held += len(enc) // 4 + 1
                    if held >= shard_tokens or len(rows) >= shard_rows:
                        yield flush()
        if rows:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None,
              shard_tokens: int = 4_000_000, shard_rows: int = 50_000, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Write the shards; returns the manifest (kept as a table in the same folder)
    with every shard's global start, the ids of all rows in earlier shards."""
    spark = docs.sparkSession
    folder = folder or workdir(spark, "ids")
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .repartitionByRange(shuffle_width(spark), "id", F.xxhash64("text")).sortWithinPartitions("id"))
    manifest = stage(rows.mapInArrow(_writer(tokenizer_path, end_id, folder, shard_tokens, shard_rows), MANIFEST),
                     f"{folder}/written")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)      # a row per shard
    return stage(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), f"{folder}/manifest")


def _fetcher(folder: str):
    """Keys in ascending order, null first, to their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = resolve(f"{folder}/manifest")
        opened: tuple[str, IdShard] | None = None

        def shards(filters) -> list[dict]:
            rows = pq.read_table(place, filesystem=fs, filters=filters,
                                 columns=["path", "start", "first_key", "last_key"]).to_pylist()
            return sorted(rows, key=lambda r: r["start"])

        for batch in batches:
            asked = batch.column(0)
            keys = np.sort(asked.drop_null().to_numpy(zero_copy_only=False))
            work = [(s, keys[:0], True) for s in shards([("n_nulls", ">", 0)])] if asked.null_count else []
            if len(keys):
                held = shards([("first_key", "<=", int(keys[-1])), ("last_key", ">=", int(keys[0]))])
                work += [(s, keys[np.searchsorted(keys, s["first_key"]):np.searchsorted(keys, s["last_key"], "right")], False)
                         for s in held]
            rows, size = [], 0
            for s, own, nulls in work:
                if not len(own) and not nulls:
                    continue
                if opened is None or opened[0] != s["path"]:
                    if opened:
                        opened[1].close()
                    opened = s["path"], IdShard(s["path"])
                for key, start, ids in opened[1].fetch(own, nulls):
                    rows.append((key, s["start"] + start, ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size >= 1 << 20:
                        yield _fetched(rows)
                        rows, size = [], 0
            if rows:
                yield _fetched(rows)
        if opened:
            opened[1].close()

    return run


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    own, starts, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["id", "start", "ids"])


def read_ids(folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored row of the keys asked for: key, global start and its ids
    (little-endian unsigned 32-bit).  A null among the keys asks for the rows
    without a key; a key that no shard holds gives no row; a key asked for twice
    counts once.

    The keys are range-partitioned, so a task meets few shards: it reads those rows
    of the manifest whose key range meets its own, opens these shards, and fetches
    each key through their index."""
    width = shuffle_width(keys.sparkSession)
    asked = keys.select(F.col(id_col).cast("long").alias("id")).distinct()
    placed = asked.repartitionByRange(width, "id").sortWithinPartitions("id")
    return placed.mapInArrow(_fetcher(folder), "id long, start long, ids binary").withColumnRenamed("id", id_col)

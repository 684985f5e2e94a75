"""Cost-balanced packing of documents into token sequences (operator 8).

The estimated cost of a piece is linear + quadratic attention: a*n + b*n*n.
Pieces go, by descending cost, to the sequence of lowest cost that still has
room for them; a piece that fits nowhere whole is cut.  A block of documents is
packed into as many full sequences as its tokens fill; what is left goes on to
the next block, so a partition ends with one unfilled sequence at most.

Every task packs the documents of its input partition, block by block: no
shuffle, no hot key, and memory for one block only.  `sequence_id` is unique
and increasing inside a partition (the partition number in its upper bits), not
consecutive; it is the same when a lost task runs again.

Defined results: a null or empty text is one end-of-document id.  Repeated rows
are packed once per row.  A null id is packed under a null id.  Pieces of equal length
are placed in the order of their documents.  A long text is cut into as many pieces as
it fills; an empty table gives no piece.  Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.tokens import ChunkEncoder, text_slices


@dataclass(frozen=True)
class PackingRules:
    capacity: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 4096      # attention over 4,096 tokens costs as much as the linear part
    block_tokens: int = 1 << 20


def pack_block(lengths: list[int], sequences: int, rules: PackingRules) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Fill `sequences` sequences from runs of the given lengths.

    Returns the placed pieces (run, start in the run, length, sequence) in the
    order of placement, and the unplaced pieces (run, start, length)."""
    cap = rules.capacity
    room = np.full(sequences, cap, dtype=np.int64)
    cost = np.zeros(sequences)
    heap: list[tuple[int, int, int]] = []          # descending length is descending cost
    for run, n in enumerate(lengths):
        for lo in range(0, n, cap):
            heap.append((-min(cap, n - lo), run, lo))
    heapq.heapify(heap)
    placed, rest = [], []
    free = sequences * cap
    while heap:
        n, run, lo = heapq.heappop(heap)
        n = -n
        if free == 0:
            rest.append((run, lo, n))
            continue
        fits = room >= n
        if fits.any():
            s = int(np.argmin(np.where(fits, cost, np.inf)))
        else:                                        # fits nowhere whole: cut
            s = int(np.argmax(room))
            take = int(room[s])
            heapq.heappush(heap, (take - n, run, lo + take))
            n = take
        placed.append((run, lo, n, s))
        room[s] -= n
        free -= n
        cost[s] += rules.linear * n + rules.quadratic * n * n
    return placed, rest


OUTPUT = ("id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _packer(path: str, end_id: int, rules: PackingRules):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = ChunkEncoder.of(path)
        next_seq = TaskContext.get().partitionId() << 33
        # runs waiting to be packed: (doc id, start in the document, document tokens, ids)
        waiting: list[tuple] = []
        tokens = 0

        def flush(last: bool):
            nonlocal waiting, tokens, next_seq
            n_seq = -(-tokens // rules.capacity) if last else tokens // rules.capacity
            placed, rest = pack_block([len(w[3]) // 4 for w in waiting], n_seq, rules)
            at = [0] * n_seq
            rows = []
            for run_no, lo, n, s in placed:
                doc, start, total, ids = waiting[run_no]
                rows.append((doc, start + lo, n, total, next_seq + s, at[s], ids[4 * lo:4 * (lo + n)]))
                at[s] += n
            next_seq += n_seq
            waiting = [(waiting[r][0], waiting[r][1] + lo, waiting[r][2], waiting[r][3][4 * lo:4 * (lo + n)])
                       for r, lo, n in rest]
            tokens = sum(len(w[3]) // 4 for w in waiting)
            names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            types = [pa.int64()] * 6 + [pa.binary()]
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            for lo, texts in text_slices(batch.column(1), 4_000_000):
                for doc, ids in zip(ids_col[lo:lo + len(texts)], encoder.encode(texts)):
                    ids += end
                    waiting.append((doc, 0, len(ids) // 4, ids))
                    tokens += len(ids) // 4
                    if tokens >= rules.block_tokens:
                        yield flush(False)
        if tokens >= rules.capacity:
            yield flush(False)
        if waiting:                          # less than one sequence
            yield flush(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, rules: PackingRules = PackingRules(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_packer(tokenizer_path, end_id, rules), OUTPUT)
    return packed.withColumnRenamed("id", id_col)

"""Byte-level BPE encoding and decoding by recursive queries (operator 11).

Every task holds a private in-memory DuckDB.  A slice of texts is cut into
words (the matches of the vocabulary's pattern); the words it has not met yet
become token-position rows, one per byte: (word, byte offset, byte length,
token, token after it).  A recursive query joins them with the merge table,
contracts each word's pair of lowest rank (of equal ranks the leftmost) and
goes on with the words that changed, until no pair of any word is in the table.
The merge table holds every split of every token into two tokens: a pair merges
whenever its joined bytes are a token, as the public library does it.
Decoding joins the rows (row, position, id) with the vocabulary and puts each
row's bytes together by an ordered aggregation.

Both directions are narrow: no shuffle, no driver work; a task that runs again
gives the same rows.  Memory is bounded by the slice (`max_chars`, or one text),
the words of one query (`QUERY_BYTES`) and the remembered words (`REMEMBERED`, of
at most `LONG_WORD` bytes each).

Defined results: a null or empty text has no ids and decodes to no bytes.  A
word of more than `LONG_WORD` bytes (a run of letters without a space) would
need as many rounds over all its rows as it has merges; the same contractions
are then taken from a heap.  Repeated rows are encoded row by row; the order of
rows is kept.  An empty table gives an empty result.  Columns besides the id and
the text are neither read nor returned, whatever their names.  A code point that
UTF-8 cannot hold cannot come out of Spark.  Decoding: null ids give no bytes; an
id that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.tokens import text_slices

LONG_WORD = 256          # bytes; longer words are contracted by a heap
QUERY_BYTES = 400_000    # bytes of words (first token-position rows) in one recursive query
QUERY_IDS = 250_000      # ids decoded in one query
REMEMBERED = 300_000     # words a worker remembers

CONTRACT = """
WITH RECURSIVE tokens(w, round, p, l, tok, nxt) AS (
    SELECT w, 0, p, 1, tok, nxt FROM start
  UNION ALL
    SELECT t.w, t.round + 1, CASE WHEN t.p = b.p + b.cut THEN b.p ELSE t.p END,
           CASE WHEN t.p = b.p + b.cut THEN t.l + b.cut ELSE t.l END,
           CASE WHEN t.p = b.p + b.cut THEN b.merged ELSE t.tok END,
           CASE WHEN t.p + t.l = b.p THEN b.merged ELSE t.nxt END
    FROM tokens t JOIN (
        -- a word's least (rank, offset, byte length): its leftmost pair of lowest rank
        SELECT w, (best // 65536 % 65536)::INTEGER AS p, (best // 4294967296)::INTEGER AS merged, (best % 65536)::INTEGER AS cut
        FROM (SELECT x.w, min(m.merged * 4294967296 + x.p * 65536 + x.l) AS best
              FROM tokens x JOIN merges m ON m.pair = x.tok::BIGINT * 4294967296 + x.nxt GROUP BY x.w)) b ON b.w = t.w
    WHERE t.p <> b.p          -- the left row of the pair goes, the right one becomes the merged token
)
SELECT w, p, tok FROM tokens JOIN (SELECT w, max(round) AS round FROM tokens GROUP BY w) USING (w, round) ORDER BY w, p
"""

DECODE = """
SELECT r, unhex(string_agg(v.piece, '' ORDER BY pos)) AS bytes, count(v.piece) AS n
FROM ids LEFT JOIN vocabulary v ON v.id = ids.id GROUP BY r ORDER BY r
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, of a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# The pattern of the public byte-level vocabularies, written for the standard library's
# faster matcher over characters whose classes are plain: ASCII, Latin letters, and
# punctuation from U+2010 to U+2027.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ODD = re.compile(f"[^\t\n\r -~{_L}\u2010-\u2027]").search
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+").findall


def words_by(findall, pattern: str):
    """The function that cuts a text into the matches of the pattern."""
    if pattern != GPT_PATTERN:
        return findall
    return lambda text: findall(text) if _ODD(text) else _PLAIN(text)


class ByteBpe:
    """Encoder and decoder of one worker process, around a private DuckDB."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        self.ranks = load_ranks(path)
        self.words_of = words_by(regex.compile(pattern).findall, pattern)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self._table("merges", pair=pa.array(pairs, pa.int64()), merged=pa.array(merged, pa.int64()))
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int64()),
                    piece=pa.array([t.hex() for t in self.ranks], pa.string()))
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("arriving", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arriving")
        self.db.unregister("arriving")

    # ---- encoding

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words of moderate length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        tok = self.byte_rank[data]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[first + sizes - 1] = -1                      # the last of a word
        self._table("start", w=pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
                    p=pa.array(np.arange(len(data)) - np.repeat(first, sizes)), tok=pa.array(tok), nxt=pa.array(nxt))
        rows = self.db.execute(CONTRACT).fetchnumpy()
        ids = rows["tok"].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(rows["w"], minlength=len(words)))).tolist()
        return [ids[lo:hi] for lo, hi in zip([0] + ends, ends)]

    def _contract_long(self, word: bytes) -> bytes:
        """The same contractions for one long word: a heap of (rank, offset)."""
        n = len(word)
        length, before = [1] * n, list(range(-1, n - 1))      # by offset; 0: contracted into another
        get = self.ranks.get
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = i + left
            if length[i] != left or length[j] != right:       # one of the two has changed since
                continue
            length[i], length[j] = left + right, 0
            k = i + left + right
            if k < n:
                before[k] = i
                if (r := get(word[i:k + length[k]])) is not None:
                    heapq.heappush(heap, (r, i, left + right, length[k]))
            h = before[i]
            if h >= 0 and (r := get(word[h:k])) is not None:
                heapq.heappush(heap, (r, h, length[h], left + right))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i:i + length[i]]])
            i += length[i]
        return np.array(out, "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        held: list[str] = []
        raw: list[bytes] = []
        size = 0
        for w in new:
            b = w.encode()
            if len(b) > LONG_WORD:
                found[w] = self._contract_long(b)
                continue
            held.append(w)
            raw.append(b)
            size += len(b)
            if size >= QUERY_BYTES:
                found.update(zip(held, self._contract(raw)))
                held, raw, size = [], [], 0
        if held:
            found.update(zip(held, self._contract(raw)))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        cut = [self.words_of(t) for t in texts]
        distinct = set().union(*cut) if cut else set()
        found = self._learn(sorted(distinct - self.known.keys()))
        self.known.update(found)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        if len(self.known) > REMEMBERED:                 # words of this slice that were known before it stay
            self.known = {w: self.known[w] for w in distinct - found.keys()}
        for w in found:
            if len(w) > LONG_WORD:
                self.known.pop(w, None)
        return out

    # ---- decoding

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of rows of ids; `ids` holds those of all rows, `sizes` their numbers."""
        out = [b""] * len(sizes)
        if not len(ids):
            return out
        self._table("ids", r=pa.array(np.repeat(np.arange(len(sizes)), sizes)), pos=pa.array(np.arange(len(ids))),
                    id=pa.array(ids))
        for r, data, n in self.db.execute(DECODE).fetchall():
            if n != sizes[r]:
                raise ValueError("an id is not in the vocabulary")
            out[r] = data
        return out


_MODELS: dict[tuple[str, str], ByteBpe] = {}


def model_of(path: str, pattern: str) -> ByteBpe:
    """The model of this worker process."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = ByteBpe(path, pattern)
    return _MODELS[path, pattern]


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, pattern)
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), 4_000_000):
                rows = model.encode(texts)
                ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows])))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), ids], names=["id", "ids"])
    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, pattern)
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(sizes):                       # QUERY_IDS rows of ids, or one text
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + QUERY_IDS, side="right")))
                ids = column.slice(lo, hi - lo).flatten()
                if ids.null_count:
                    raise ValueError("an id is null")
                rows = model.decode(sizes[lo:hi], ids.to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())],
                                                 names=["id", "bytes"])
                lo = hi
    return run


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id (a column of any type), ids (array of int)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(ranks_path, pattern), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_bytes(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id (a column of any type), bytes (the text's; a cut of ids may not be whole UTF-8)."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoder(ranks_path, pattern), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)

"""Byte-level BPE: learn merges, encode, decode, on Spark.

Learning.  Pre-token counting is one distributed aggregate over all texts.  Two
tables carry the rest: the distinct words (symbol ids, frequency) and the pair counts
(pair, count, symbols of the words that hold it).  The pair counts are made once;
every round after that adds the differences that the changed words give.

A round takes as many merges as can be decided exactly:

  The pairs are listed by (count desc, left id, right id), as long as the words that hold
  them stay within `ROUND_SYMBOLS` symbols.  These words are fetched, a bounded set,
  and merges are done on them one at a time.  For the listed pairs and for all pairs
  with a token made in this round, the counts there are the counts of the whole corpus,
  since no other word holds them.  A merge only lowers the counts of the pairs that
  were not listed, so none of these can come before the first of them in the list
  order: merges go on until the next one would lie behind that place, or would give a
  token that existed before the round.

  Where these words are too many for a list of some length, as over a large corpus, every word is
  cut between its symbols that are no listed pair, and only the distinct segments of two
  symbols or more are fetched, with the sums of their words' frequencies.  They are as good
  as the words, as long as every token of this round has been made of one pair: where two
  tokens meet that this round has made, their neighbouring symbols of before the round are
  one certain pair.  If this is listed all its places are inside of segments, if not the two
  tokens meet at most as often as that pair did, and come after it at the same count, that
  is, behind the place where the round ends.  A merge that gives a token made
  by another pair ends the round.  The list is shortened until the segments stay within
  `ROUND_SYMBOLS`, and made longer in the next round where they leave room.

  Where even that gives fewer merges than the list itself, they are taken from the list: scan it in order.  Merging
  (x, y) changes only the pairs that end in x or begin with y, since no other pair can
  overlap an occurrence of it; accept a pair q while neither it nor its result token is
  changed by a pair accepted before it.  The first changed pair r ends the round.
  Nothing can come before q: a new pair (x, new) or (new, z) occurs at most as often as
  the changed pair (x, y) or (y, z) it came from, which is r or a later one.  At the same
  count it is still after q, as (x, y) is, because `new` is the largest id.  A pair (x, x)
  also makes pairs of its own result, at most half as many, which bound the round as well.

The merges of a round are then applied to all words that hold one of them, in an Arrow
UDF that cuts the words into the same segments by whole arrays and merges each distinct one once.  Lineage is cut by `checkpoint()` into the
shared checkpoint folder every few rounds.

Encoding.  Special tokens are split off first, the rest is NFKC-normalised and
pre-tokenised, and every pre-token is merged by rank from a heap (so a very long one
costs no more than n log n), all inside one Arrow UDF.
Decoding maps ids to bytes and bytes to UTF-8, likewise.  Both tables are
broadcast; their size is bounded by the vocabulary size.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import text as X

# Pre-token pattern of byte-level BPE (GPT-2 style), Java regex with Unicode classes.
PRETOKEN_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """Visible character for every byte value 0..255: printable bytes
    33-126, 161-172, 174-255 stand for themselves; the other 68, in
    ascending order, take code points 256, 257, ..."""
    keep = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


BYTE_CHARS = byte_chars()
ALPHABET = sorted(BYTE_CHARS)                         # ids 11..266 by code point
N_SPECIAL = len(C.SPECIAL_TOKENS)
CHAR_ID = {c: N_SPECIAL + i for i, c in enumerate(ALPHABET)}
BYTE_ID = [CHAR_ID[c] for c in BYTE_CHARS]            # byte value -> initial id
SPECIAL_ALT = "|".join(t.replace("[", r"\[").replace("]", r"\]").replace("/", r"\/") for t in C.SPECIAL_TOKENS)


def _nfkc(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFKC", t)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC normalisation (no SQL built-in); Arrow batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


_SYMBOL_OF_BYTE = np.array(BYTE_ID, dtype=np.int32)


def initial_symbols(token: Column) -> Column:
    """Initial symbol ids of a pre-token: its UTF-8 bytes through the byte map, whole Arrow arrays."""
    @F.arrow_udf("array<int>")
    def symbols(column: pa.Array) -> pa.Array:
        words = column.cast(pa.large_binary()).to_pylist()
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        flat = _SYMBOL_OF_BYTE[np.frombuffer(b"".join(words), dtype=np.uint8)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
    return symbols(token)


# the pre-token pattern for Python's `regex` module, with the Unicode white space of (?U)
_PRETOKEN = regex.compile(PRETOKEN_PATTERN.removeprefix("(?U)").replace(r"[^\s", r"[^\p{White_Space}")
                          .replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _char_kinds() -> np.ndarray:
    """The kind of every code point, as the pattern tells them apart."""
    kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, of in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(of, every):
            kinds[m.start():m.end()] = kind
    return kinds


_JVM_KINDS: list[tuple[np.ndarray, np.ndarray]] = []


def _jvm_kinds(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """The code points to which the JVM, by its version of Unicode, gives other kinds, and these.
    Counting takes the JVM's kinds."""
    if not _JVM_KINDS:
        pattern = spark.sparkContext._jvm.java.util.regex.Pattern
        every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
        kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
        for kind, of in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            found = pattern.compile(f"(?U)[^{of}]+").matcher(every).replaceAll("")
            kinds[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        at = np.flatnonzero(kinds != _char_kinds())
        _JVM_KINDS.append((at, kinds[at]))
    return _JVM_KINDS[0]


def cut_pretokens(texts: list[str], whole: np.ndarray | None = None,
                  kind_of: np.ndarray | None = None) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pre-tokens of texts, as `_PRETOKEN` finds them, and the number of each one's text.
    Texts marked `whole` are one pre-token; `kind_of` replaces the kinds of the code points.

    A pre-token begins where the kind of the characters changes; but the last one of a run of
    white space before another character stands alone, and joins that one if it is a plain space; and an
    apostrophe alone before certain letters takes these."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    n = len(chars)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    kinds = (_char_kinds() if kind_of is None else kind_of)[chars]
    begins = np.ones(n + 1, dtype=bool)
    begins[1:n] = kinds[1:] != kinds[:-1]
    begins[starts] = True
    opens = np.zeros(n + 1, dtype=bool)                  # first characters of texts
    opens[starts] = opens[n] = True
    follows = np.flatnonzero(begins[1:n] & (kinds[:-1] == _SPACE) & ~opens[1:n]) + 1
    begins[follows - 1] = True
    begins[follows] = chars[follows - 1] != ord(" ")
    at = np.flatnonzero((chars[:-1] == ord("'")) & begins[:n - 1] & (kinds[1:] == _LETTER) & ~opens[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(at):
        one, two = chars[at + 1], chars[np.minimum(at + 2, n - 1)]
        more = ~opens[at + 2]                            # the text goes on behind the first letter
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = more & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        begins[at[short | long] + 1] = False
        begins[at[short] + 2] = True
        begins[at[long] + 3] = True
    first = np.flatnonzero(begins[:n])
    owner = np.searchsorted(np.cumsum(sizes), first, side="right")
    if whole is not None:
        stay = ~whole[owner] | opens[first]
        first, owner = first[stay], owner[stay]
    bounds = np.append(first, n)
    if not joined.isascii():                             # bytes of the characters, summed up by pre-tokens
        width = (chars >= 0x80).view(np.uint8) + (chars >= 0x800).view(np.uint8) + (chars >= 0x10000).view(np.uint8)
        bounds[1:] += np.cumsum(np.add.reduceat(width, first, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(joined.encode())]), owner


def pretoken_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, freq) over NFKC-normalised texts; counted in every slice of texts, then summed."""
    bc = texts.sparkSession.sparkContext.broadcast(_jvm_kinds(texts.sparkSession))      # some 10,000 code points

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = _char_kinds().copy()
        kind_of[bc.value[0]] = bc.value[1]
        for batch in batches:
            column = batch.column(0)
            for lo, n in X.row_slices(column):
                found = cut_pretokens([_nfkc(t) for t in column.slice(lo, n).to_pylist() if t], kind_of=kind_of)[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")],
                                                 names=["token", "n"])
    return texts.select(F.col(text).alias("t")).mapInArrow(counts, "token string, n long") \
        .groupBy("token").agg(F.sum("n").alias("freq"))


# ------------------------------------------------------------------------- learning

ROUND_SYMBOLS = 12_000_000     # symbols of the words of one round, on the driver (about 40 bytes each)
MAX_CANDIDATES = 20_000        # pairs listed in one round
FIRST_LIST = 64                # pairs listed in the first round over segments
SEGMENT_MEMORY = 100_000       # segments a Python worker remembers


def merge_symbols(sym: list[int], ranks: dict, again: bool = True) -> list[int]:
    """Merge the adjacent pair of lowest rank (of these the leftmost) until none is in
    `ranks` ((left, right) -> (rank, id)).  With `again` false the merges are passed once, in
    order: a pair that only arises after its turn stays."""
    n = len(sym)
    sym, after, before = list(sym), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(sym, sym[1:])) if p in ranks]
    heapq.heapify(heap)
    done = -1
    while heap:
        rank, i, p = heapq.heappop(heap)
        j = after[i]
        if sym[i] != p[0] or j >= n or sym[j] != p[1]:    # one of the two has changed since
            continue
        done = max(done, rank)
        sym[i], sym[j] = ranks[p][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                found = ranks.get((sym[a], sym[b]))
                if found and (again or found[0] >= done):
                    heapq.heappush(heap, (found[0], a, (sym[a], sym[b])))
    return [x for x in sym if x >= 0]


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of every adjacent pair, its word) of a column of symbol arrays."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[1:] == owner[:-1]
    return ((flat[:-1] << 32) | flat[1:])[inside], owner[1:][inside]


def _holders(words: pa.Array, codes: np.ndarray) -> np.ndarray:
    """Numbers of the words that hold one of the (sorted) pair codes."""
    pairs, owner = _codes(words)
    at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
    return np.unique(owner[codes[at] == pairs])


def _code(a: int, b: int) -> int:
    return a << 32 | b


def _pair_rows(words: DataFrame, sign: int = 1) -> DataFrame:
    """(p, c, l) of every pair of a batch of words, summed over the batch: pair code, occurrences
    x frequency, symbols of the words that hold it."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, owner = _codes(batch.column("s"))
            if not len(codes):
                continue
            freq, size = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("f", "l"))
            order = np.lexsort((owner, codes))
            codes, owner, freq, size = codes[order], owner[order], freq[order], size[order]
            begins = np.concatenate(([True], codes[1:] != codes[:-1]))
            again = ~begins                              # a word's length counts once for a pair
            again[1:] &= owner[1:] == owner[:-1]
            size[again] = 0
            first = np.flatnonzero(begins)
            yield pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(sign * np.add.reduceat(freq, first)),
                                              pa.array(sign * np.add.reduceat(size, first))], names=["p", "c", "l"])
    return words.select("s", "f", "l").mapInArrow(pairs, "p long, c long, l long")


def _sum_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("p").agg(F.sum("c").alias("c"), F.sum("l").alias("l")).where("c > 0")


def _segments(words: pa.Array, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column of symbol arrays as one array, the number of each symbol's word, and the first and
    last-but-one places of the segments: the longest runs of symbols of a word whose adjacent pairs
    all are among the (sorted) codes.  Without codes every word is one."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.ascontiguousarray(words.flatten().to_numpy(), dtype=np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    live = owner[1:] == owner[:-1]
    if codes is not None:
        at = np.flatnonzero(live)
        pairs = (flat[at].astype(np.int64) << 32) | flat[at + 1]
        live[at] = codes[np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)] == pairs
    edge = np.diff(live.astype(np.int8), prepend=0, append=0)
    return flat, owner, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


def _distinct(flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The segments as bytes, numbered."""
    bounds = np.concatenate(([0], np.cumsum(end - first)))
    symbols = flat[np.repeat(first - bounds[:-1], end - first) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(4 * bounds), pa.py_buffer(symbols)]) \
        .dictionary_encode()


def _segment_counts(words: DataFrame, codes: np.ndarray) -> DataFrame:
    """(g, f): every distinct segment of the words (s, f), and the sum of its words' frequencies."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, owner, first, end = _segments(batch.column("s"), codes)
            if len(first):
                found = _distinct(flat, first, end)
                freq = batch.column("f").to_numpy(zero_copy_only=False)[owner[first]]
                sums = np.zeros(len(found.dictionary), dtype=np.int64)
                np.add.at(sums, found.indices.to_numpy(zero_copy_only=False), freq)
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.binary()), pa.array(sums)], names=["g", "f"])
    return words.select("s", "f").mapInArrow(segments, "g binary, f long").groupBy("g").agg(F.sum("f").alias("f"))


def _merged_words(words: pa.Array, codes: np.ndarray | None, ranks: dict, known: dict) -> pa.Array:
    """The words after the merges, null where nothing changed; `known` remembers segments."""
    flat, owner, first, end = _segments(words, codes)
    found = _distinct(flat, first, end)
    if len(known) > SEGMENT_MEMORY:
        known.clear()
    new = []
    for g in found.dictionary.to_pylist():
        if g not in known:
            sym = np.frombuffer(g, np.int32).tolist()
            m = merge_symbols(sym, ranks, again=False)
            known[g] = np.array(m, dtype=np.int32) if len(m) < len(sym) else None
        new.append(known[g])
    number = found.indices.to_numpy(zero_copy_only=False)
    hit = np.array([m is not None for m in new], dtype=bool)[number]
    first, end, number = first[hit], end[hit], number[hit]
    changed = np.zeros(len(words), dtype=bool)
    changed[owner[first]] = True
    # every place gives itself, but the first of a segment that changed what this became, and its others nothing
    size = np.array([0 if m is None else len(m) for m in new], dtype=np.int64)
    gives, source = changed[owner].astype(np.int64), np.arange(len(flat))
    inside = np.zeros(len(flat) + 1, dtype=np.int64)
    inside[first] += 1
    inside[end] -= 1
    gives[np.cumsum(inside[:-1]) > 0] = 0
    gives[first], source[first] = size[number], len(flat) + (np.cumsum(size) - size)[number]
    pool = np.concatenate([flat, *(m for m in new if m is not None)])
    ends = np.cumsum(gives)
    values = pool[np.repeat(source - (ends - gives), gives) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate(([0], ends))[np.searchsorted(owner, np.arange(len(words) + 1))]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()), mask=pa.array(~changed))


def _merge_words(spark: SparkSession, words: DataFrame, merges: list[tuple[int, int, int]],
                 codes: np.ndarray | None = None) -> DataFrame:
    """The words (s, f, l) with `old`: the symbols before this round, null where nothing changed.

    No merge joins two neighbours of before the round whose code is not among `codes` (sorted; None: any)."""
    # merges of one round: bounded by the vocabulary size
    bc = spark.sparkContext.broadcast(({(a, b): (i, t) for i, (a, b, t) in enumerate(merges)}, codes))

    @F.arrow_udf("array<int>")
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, codes = bc.value
        known: dict = {}
        for column in batches:
            yield _merged_words(column, codes, ranks, known)
    changed = words.select("s", "f", merged(F.col("s")).alias("new"))
    return changed.select(F.coalesce("new", "s").alias("s"), "f", F.size(F.coalesce("new", "s")).cast("long").alias("l"),
                          F.when(F.col("new").isNotNull(), F.col("s")).alias("old"))


def _sums(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of every distinct code."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights[order], first)


class _Chain:
    """The symbols of all fetched words in one array, linked to their neighbours (-1: none),
    and the places where the listed pairs and those with a token of this round begin.

    A place leaves its list only when it is read: it counts while its pair still stands there."""

    def __init__(self, sizes: np.ndarray, symbols: np.ndarray, freqs: np.ndarray, listed: np.ndarray):
        n = len(symbols)
        self.sym = symbols.astype(np.int32)
        self.freq, self.word = freqs, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        self.after[ends[sizes > 0] - 1] = -1
        self.before[(ends - sizes)[sizes > 0]] = -1
        codes = self.codes(np.flatnonzero(self.after >= 0))
        starts = np.flatnonzero(self.after >= 0).astype(np.int32)
        wanted = listed[np.minimum(np.searchsorted(listed, codes), len(listed) - 1)] == codes
        self.places: dict[int, list[np.ndarray]] = defaultdict(list)
        self.add(codes[wanted], starts[wanted])

    def codes(self, at: np.ndarray) -> np.ndarray:
        """Codes of the pairs that begin at these places."""
        return (self.sym[at].astype(np.int64) << 32) | self.sym[self.after[at]]

    def add(self, codes: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
        for code, lo, hi in zip(codes[first].tolist(), first.tolist(), np.append(first[1:], len(codes)).tolist()):
            self.places[code].append(at[lo:hi].copy() if len(first) > 1 and hi - lo < 64 else at[lo:hi])

    def merge(self, a: int, b: int, new: int, known: int) -> tuple[list[int], list[int]]:
        """Merge the pair everywhere, from the left; returns pair codes and their changes of count."""
        at = np.sort(np.concatenate(self.places.pop(_code(a, b))))
        right = self.after[at]
        at = at[(self.sym[at] == a) & (right >= 0) & (self.sym[right] == b)]
        if a == b and len(at):                           # of a run every second place
            begins = np.concatenate(([True], self.after[at[:-1]] != at[1:]))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        right = self.after[at]
        far = self.after[right]
        left = self.before[at]
        old = np.unique(np.concatenate((left[left >= 0], at, right[far >= 0])))
        old_codes, old_freq = self.codes(old), self.freq[self.word[old]]
        self.sym[at] = new
        self.sym[right] = -1
        self.after[at] = far
        self.before[far[far >= 0]] = at[far >= 0]
        left = self.before[at]
        now = np.unique(np.concatenate((left[left >= 0], at[self.after[at] >= 0])))
        now_codes, now_freq = self.codes(now), self.freq[self.word[now]]
        fresh = ((now_codes >> 32) >= known) | ((now_codes & 0xFFFFFFFF) >= known)
        self.add(now_codes[fresh], now[fresh])
        codes, change = _sums(np.concatenate((old_codes, now_codes)), np.concatenate((-old_freq, now_freq)))
        return codes[change != 0].tolist(), change[change != 0].tolist()


def _replay(chain: _Chain, counts: dict[int, int], limit: tuple | None, vocab_strings: list[str],
            token_id: dict, room: int, min_frequency: int, once: bool = False) -> list[tuple[int, int, int]]:
    """Merges on the fetched words, one at a time, in the order of (count desc, ids).

    `counts` holds the listed pairs by their codes; `limit` is the place (-count, code) of the
    first pair that is not listed.  New tokens are added to the vocabulary.  With `once` a merge that
    gives a token of an earlier one ends the round."""
    known = len(vocab_strings)
    heap = [(-c, p) for p, c in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and len(merges) < room:
        place = heapq.heappop(heap)
        p = place[1]
        if counts.get(p, 0) != -place[0]:
            continue                                     # counted anew since
        if -place[0] < min_frequency or (limit is not None and place >= limit):
            break
        a, b = p >> 32, p & 0xFFFFFFFF
        s = vocab_strings[a] + vocab_strings[b]
        old = token_id.get(s)
        if old is not None and (once or old < known) and merges:
            break                                        # an earlier token: pairs around it occur elsewhere too
        new = len(vocab_strings) if old is None else old
        if old is None:
            vocab_strings.append(s)
            token_id[s] = new
        merges.append((a, b, new))
        if old is not None and old < known:
            break
        for q, d in zip(*chain.merge(a, b, new, known)):
            if q in counts or (q >> 32) >= known or (q & 0xFFFFFFFF) >= known:
                counts[q] = c = counts.get(q, 0) + d
                if c > 0:
                    heapq.heappush(heap, (-c, q))
    return merges


def _select_batch(cands, vocab_strings, token_id, room, min_frequency, complete):
    """Choose the merges of one round from candidates sorted by
    (count desc, a, b).  Returns [(a, b, existing_id_or_None, string, count)]."""
    batch, firsts, seconds, new_strings = [], set(), set(), set()
    bound = None
    for a, b, cnt in cands:
        if cnt < min_frequency or len(batch) >= room:
            bound = max(bound or 0, cnt)
            break
        s = vocab_strings[a] + vocab_strings[b]
        t = token_id.get(s)
        existing = t is not None or s in new_strings
        # merging (x, y) changes only pairs that end in x or begin with y
        if batch and (b in firsts or a in seconds or existing):
            bound = max(bound or 0, cnt)          # every later pair has a count <= cnt
            break
        batch.append((a, b, t, s, cnt))
        if a == b:
            # a run of one symbol: the new pairs (aa, aa) and (aa, a) come from the
            # accepted pair itself; two new tokens need two of its occurrences
            bound = max(bound or 0, cnt // 2)
        firsts.add(a)
        seconds.add(b)
        new_strings.add(s)
        if existing:
            # the result is an existing token: pairs around it may gain
            # counts, so this merge closes the round on its own
            bound = float("inf")
            break
    else:
        if not complete and cands:
            bound = max(bound or 0, cands[-1][2])      # pairs not listed have at most this count
    if bound is not None:
        batch = batch[:1] + [x for x in batch[1:] if x[4] >= bound]
    return batch


def word_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """(s, f, l): symbols, frequency and length of every distinct pre-token of two symbols or more
    (one symbol never yields a pair)."""
    words = pretoken_counts(texts, text).select(initial_symbols(F.col("token")).alias("s"), F.col("freq").cast("long").alias("f"))
    return words.filter(F.size("s") >= 2).withColumn("l", F.size("s").cast("long"))


def pair_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(p, c, l) of every adjacent pair of initial symbols: code, occurrences, symbols of its words."""
    return _sum_pairs(_pair_rows(word_table(texts, text)))


def learn_bpe(spark: SparkSession, texts: DataFrame, text: str = "text", vocab_size: int = C.VOCAB_SIZE,
              min_frequency: int = C.MIN_FREQUENCY, round_symbols: int = ROUND_SYMBOLS,
              checkpoint_every: int = 8) -> tuple[DataFrame, DataFrame]:
    """Learn merges.  Returns (vocab(token, id), merges(rank, left, right, id))."""
    # the distinct-word table may come out of the aggregate as one partition (AQE
    # coalesces small results); every round works on it, so give it one partition per
    # core at least
    target = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = word_table(texts, text).repartition(target).checkpoint(eager=True)
    pairs = _sum_pairs(_pair_rows(words)).checkpoint(eager=True)

    vocab_strings = list(C.SPECIAL_TOKENS) + ALPHABET
    token_id = {t: i for i, t in enumerate(vocab_strings)}
    merges: list[tuple[int, int, int]] = []
    rounds, wide = 0, FIRST_LIST
    older: list[DataFrame] = []
    newer: list[DataFrame] = []
    while len(vocab_strings) < vocab_size:
        top = (pairs.where(F.col("c") >= min_frequency).orderBy(F.col("c").desc(), "p").limit(MAX_CANDIDATES + 1).collect())
        for d in older:           # the caches of the round before this one's are filled from them now
            d.unpersist()
        older = newer
        if not top:
            break
        room = vocab_size - len(vocab_strings)
        listed = [(r["p"] >> 32, r["p"] & 0xFFFFFFFF, r["c"]) for r in top]
        held = itertools.accumulate(r["l"] for r in top[:MAX_CANDIDATES])
        n = sum(1 for x in itertools.takewhile(lambda x: x <= round_symbols, held))
        batch = _select_batch(listed[:256], vocab_strings, token_id, room, min_frequency, len(listed) <= 256)
        codes = segments = None
        k = min(wide, len(top), MAX_CANDIDATES)
        while max(n, len(batch)) < k:
            segments = _segment_counts(words, np.sort(np.array([r["p"] for r in top[:k]]))).persist()
            size = (segments.agg(F.sum(F.length("g"))).first()[0] or 0) // 4
            if size <= round_symbols:
                wide = 4 * k if size < round_symbols // 16 else 2 * k if size < round_symbols // 4 else k
                break
            segments.unpersist()
            segments, wide, k = None, k // 2, k // 2
        if segments is not None:
            codes = np.sort(np.array([r["p"] for r in top[:k]]))
            fetched = segments.toArrow()                 # at most round_symbols symbols
            own = fetched.column("g").combine_chunks().cast(pa.large_binary())
            chain = _Chain(pc.binary_length(own).to_numpy() // 4, np.frombuffer(b"".join(own.to_pylist()), np.int32),
                           fetched.column("f").to_numpy(), codes)
            segments.unpersist()
            limit = (-top[k]["c"], top[k]["p"]) if k < len(top) else None
            chosen = _replay(chain, {r["p"]: r["c"] for r in top[:k]}, limit, vocab_strings, token_id, room, min_frequency, once=True)
            del fetched, own, chain
        elif n and n >= len(batch):
            codes = np.sort(np.array([r["p"] for r in top[:n]]))

            @F.arrow_udf("boolean")
            def holds(column: pa.Array) -> pa.Array:
                found = np.zeros(len(column), dtype=bool)
                found[_holders(column, codes)] = True
                return pa.array(found)
            # at most round_symbols symbols
            fetched = words.where(holds(F.col("s"))).select("s", "f").toArrow()
            own = fetched.column("s").combine_chunks()
            chain = _Chain(own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), own.flatten().to_numpy(),
                           fetched.column("f").to_numpy(), codes)
            limit = (-top[n]["c"], top[n]["p"]) if n < len(top) else None
            chosen = _replay(chain, {r["p"]: r["c"] for r in top[:n]}, limit, vocab_strings, token_id, room, min_frequency)
            del fetched, own, chain
            if len({t for _, _, t in chosen}) < len(chosen):
                codes = None                             # a token of two pairs may meet others over pairs that are not listed
        else:
            chosen = []
            for a, b, t, s, _ in batch:
                if t is None:
                    t = token_id[s] = len(vocab_strings)
                    vocab_strings.append(s)
                chosen.append((a, b, t))
            codes = np.sort(np.array([_code(a, b) for a, b, _ in chosen]))
        merges += chosen
        rounds += 1
        # each round reads the tables of the round before from memory (a lost cached
        # block is recomputed from lineage); lineage itself is cut by a reliable
        # checkpoint every few rounds
        both = _merge_words(spark, words, chosen, codes).persist()
        changed = both.where(F.col("old").isNotNull())
        before = changed.select(F.col("old").alias("s"), "f", F.size("old").cast("long").alias("l"))
        pairs = _sum_pairs(pairs.unionByName(_pair_rows(before, -1)).unionByName(_pair_rows(changed.select("s", "f", "l"))))
        words = both.where("l >= 2").drop("old")
        if rounds % checkpoint_every == 0:
            pairs, words = pairs.checkpoint(eager=True), words.checkpoint(eager=True)
            newer = [both]
        else:
            pairs = pairs.persist()
            newer = [both, pairs]
    for d in older + newer:
        d.unpersist()
    learn_bpe.last_rounds = rounds
    vocab = spark.createDataFrame(list(zip(vocab_strings, range(len(vocab_strings)))), "token string, id int")
    merge_df = spark.createDataFrame([(i, a, b, t) for i, (a, b, t) in enumerate(merges)],
                                     "rank int, left int, right int, id int")
    return vocab, merge_df


# ------------------------------------------------------------------------- encoding

_SPECIALS = regex.compile(f"({SPECIAL_ALT})")
WORD_MEMORY = 200_000          # words a Python worker remembers


def _encode_word(token: str, ranks: dict) -> list[int]:
    return merge_symbols([BYTE_ID[b] for b in token.encode("utf-8")], ranks)


class _Ranks:
    """The merges as arrays: sorted codes of the pairs, their ranks, and the id that a rank gives."""

    def __init__(self, merges: list):
        self.table = {(r["left"], r["right"]): (r["rank"], r["id"]) for r in merges}
        codes = np.array([_code(a, b) for a, b in self.table] or [-1], dtype=np.int64)
        ranks = np.array([r for r, _ in self.table.values()] or [0], dtype=np.int64)
        self.codes, self.ranks = np.sort(codes), ranks[np.argsort(codes)]
        self.ids = np.zeros(int(ranks.max()) + 1, dtype=np.int64)
        for rank, t in self.table.values():
            self.ids[rank] = t

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER for what is no merge."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER)


NEVER = 1 << 31
LONG_WORD = 64                 # bytes; a longer word is merged by itself, from a heap


def _encode_words(words: list[str], ranks: _Ranks) -> list[list[int]]:
    """Ids of words.  Each step merges in every word its pair of lowest rank, of these the leftmost."""
    data = [w.encode("utf-8") for w in words]
    out: list = [merge_symbols([BYTE_ID[b] for b in d], ranks.table) if len(d) > LONG_WORD else None for d in data]
    live = np.array([i for i, ids in enumerate(out) if ids is None], dtype=np.int64)
    sizes = np.array([len(data[i]) for i in live], dtype=np.int64)
    sym = _SYMBOL_OF_BYTE[np.frombuffer(b"".join(data[i] for i in live), dtype=np.uint8)].astype(np.int64)
    rank = np.full(len(sym), NEVER, dtype=np.int64)
    rank[:-1] = ranks.of(sym[:-1], sym[1:])
    rank[np.cumsum(sizes) - 1] = NEVER                   # of the pair that begins at each place
    while len(live):
        n, ends = len(sym), np.cumsum(sizes)
        lowest = np.minimum.reduceat(rank * n + np.arange(n), ends - sizes)
        going = lowest < NEVER * n
        for i, lo, hi in zip(live[~going].tolist(), (ends - sizes)[~going].tolist(), ends[~going].tolist()):
            out[i] = sym[lo:hi].tolist()
        at, first, end = lowest[going] % n, (ends - sizes)[going], ends[going]
        new = ranks.ids[lowest[going] // n]
        sym[at] = new
        behind, before = at + 2 < end, at > first
        rank[at] = NEVER
        rank[at[behind]] = ranks.of(new[behind], sym[at[behind] + 2])
        rank[at[before] - 1] = ranks.of(sym[at[before] - 1], new[before])
        keep = np.repeat(going, sizes)
        keep[at + 1] = False
        sym, rank, live, sizes = sym[keep], rank[keep], live[going], sizes[going] - 1
    return out


def encode(texts: DataFrame, key: str, text: str, vocab: DataFrame, merges: DataFrame,
           max_len: int | None = C.MAX_SEQ_LEN) -> DataFrame:
    """(key, input_ids, attention_mask, labels, n_ids, truncated); `max_len` None: never cut.

    Each text is encoded where it is, in Arrow batches: no exchange, so neither a
    frequent token nor a long text meets others.  The texts of a slice are cut by whole
    arrays, distinct words merged together, and a worker remembers a bounded number of words."""
    # bounded by the vocabulary size: the merge table is broadcast to the tasks
    bc = texts.sparkSession.sparkContext.broadcast(_Ranks(merges.collect()))
    special_ids = {t: i for i, t in enumerate(C.SPECIAL_TOKENS)}

    def ids_of_slice(texts: list[str], ranks: _Ranks, words: dict) -> pa.ListArray:
        parts, of, whole = [], [], []
        for i, t in enumerate(texts):
            for k, piece in enumerate(_SPECIALS.split(t)):       # every second one is a special token
                if piece:
                    parts.append(piece if k % 2 else _nfkc(piece))
                    of.append(i)
                    whole.append(k % 2 == 1)
        tokens, part = cut_pretokens(parts, np.array(whole, dtype=bool))
        found = tokens.dictionary_encode()
        if len(words) > WORD_MEMORY:
            words.clear()
        distinct = found.dictionary.to_pylist()
        words.update((t, [i]) for t, i in special_ids.items())
        fresh = [t for t in distinct if t not in words]
        words.update(zip(fresh, _encode_words(fresh, ranks)))
        ids = [words[t] for t in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))
        number = found.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[number])
        n = int(ends[-1]) if len(ends) else 0
        values = flat[np.repeat((np.cumsum(size) - size)[number] - (ends - size[number]), size[number]) + np.arange(n)]
        row = np.array(of, dtype=np.int64)[part]         # of every token
        bounds = np.concatenate(([0], ends))[np.searchsorted(row, np.arange(len(texts) + 1))]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, words = bc.value, {}
        for column in batches:
            yield pa.concat_arrays([ids_of_slice(column.slice(lo, n).fill_null("").to_pylist(), ranks, words)
                                    for lo, n in X.row_slices(column)])

    res = texts.select(key, ids_of(F.col(text)).alias("_all"))
    ids = F.col("_all") if max_len is None else F.slice("_all", 1, max_len)
    return res.select(key, ids.alias("input_ids"),
                      F.transform(ids, lambda x: F.lit(1)).alias("attention_mask"),
                      ids.alias("labels"),
                      F.size(ids).cast("long").alias("n_ids"),
                      (F.size("_all") > F.size(ids)).alias("truncated"))


def decode(encoded: DataFrame, key: str, vocab: DataFrame, ids_col: str = "input_ids") -> DataFrame:
    """(key, text): ids -> token characters -> bytes -> UTF-8 (specials kept as
    text; a character cut at the end becomes U+FFFD).  No exchange."""
    byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
    surface = {r["id"]: (r["token"].encode() if r["id"] < N_SPECIAL else bytes(byte_of[c] for c in r["token"]))
               for r in vocab.collect()}             # bounded by the vocabulary size
    bc = encoded.sparkSession.sparkContext.broadcast(surface)

    @F.pandas_udf(T.StringType())
    def text_of(ids: pd.Series) -> pd.Series:
        table = bc.value
        return ids.map(lambda x: b"".join(table[int(i)] for i in x).decode("utf-8", "replace"))

    return encoded.select(key, text_of(F.col(ids_col)).alias("text"))

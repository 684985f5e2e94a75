"""Periodic runs of words, by recompression (operator 12).

A run is a stretch of consecutive words of smallest period q, as long as keeping
that period allows, of at least `min_exponent` periods and `min_length` words.
All runs of every text are found, and a collapsed text keeps the first period of
each.

Method, for a batch of texts put one after another with separators that occur once:

1. Grammar.  Block compression replaces every stretch of k equal symbols by the
   symbol (a, k); pair compression splits the symbols into two classes and
   replaces neighbours (left class, right class) by a symbol of the pair.  The two
   alternate until a few symbols a text are left.  Equal symbols of a level
   stand for equal words; the cuts depend on neighbours only, so equal stretches
   are cut alike but for their ends.
2. Candidates.  A run of period q holds `min_exponent` - 1 periods of consecutive
   places x at which word x equals word x + q.  So for every q the places x that
   are multiples of (min_exponent - 1) * q meet each run at least once: n / q of
   them for a q, n log n in all (the harmonic grid).  A place whose word differs from
   the word q on, or both of whose neighbours do, belongs to no run (but to those of
   two words).
3. Extension.  The longest common extensions of x and x + q to both sides give
   the run exactly.  They climb the grammar level by level while the symbols
   agree, and go down where they differ: a number of steps in the logarithm of
   the length, and a block is passed in one step.  No suffix arrays, no scan of words.

The same stretch, found with a multiple of its period, is kept with the smallest.

Everything is inside one row: no shuffle.  A task holds one batch of words
(`BATCH_WORDS`, or one text, whose memory is a multiple of its words; candidates come
in blocks of bounded size), and gives the same rows when it runs again.

Defined results: a null or empty text, or one of white space only, has no words, no
runs and an empty collapsed text.  Texts are whole, however long.  Runs that start
at the same word are ordered by period.  Repeated rows are treated row by row; an
empty table gives an empty result.  Columns besides the id (of any type) and the
text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.tokens import text_slices

BATCH_WORDS = 300_000        # words of a grammar, unless one text is longer
GRID_BLOCK = 2_000_000       # candidates looked at together


class Level:
    """One sequence of symbols, seen in one direction."""

    def __init__(self, symbols: np.ndarray, left: np.ndarray | None, starts: np.ndarray | None,
                 parent: np.ndarray | None, child: np.ndarray | None):
        self.symbols = symbols      # names
        self.left = left            # equal symbols from here to the end of the block; None: one everywhere
        self.starts = starts        # whether a symbol is the first of its parent; None at the top
        self.parent = parent        # place of the parent in the next level; None at the top
        self.child = child          # place of the first child of every symbol of the next level


def _blocks(symbols: np.ndarray) -> np.ndarray:
    """Whether a symbol differs from the one before it."""
    return np.concatenate(([True], symbols[1:] != symbols[:-1]))


def _classes(names: np.ndarray, seed: int) -> np.ndarray:
    """A class, left (False) or right, for every name."""
    with np.errstate(over="ignore"):
        z = (names.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(41)) & np.uint64(1) == 1


def _pairs(symbols: np.ndarray, seed: int) -> np.ndarray:
    """Whether a symbol starts a parent: not the second of a pair (left class, right class)."""
    right = _classes(symbols, seed)
    starts = np.ones(len(symbols), dtype=bool)
    starts[1:] = right[:-1] | ~right[1:]
    return starts


class Grammar:
    """Levels of one sequence of non-negative symbols, forwards and backwards."""

    def __init__(self, symbols: np.ndarray, enough: int = 1):
        self.forward: list[Level] = []
        self.backward: list[Level] = []
        symbols = symbols.astype(np.int64)
        seed = idle = 0
        blocks = True
        while len(symbols) > enough and idle < 8:
            starts = _blocks(symbols) if blocks else _pairs(symbols, seed)
            seed += 1
            first = np.flatnonzero(starts)
            if len(first) == len(symbols):               # nothing to contract: the next class split or block step
                idle += not blocks
                blocks = not blocks
                continue
            idle = 0
            sizes = np.diff(first, append=len(symbols))
            if blocks:
                names = symbols[first] * (int(sizes.max()) + 1) + sizes
            else:
                second = np.where(sizes == 2, symbols[np.minimum(first + 1, len(symbols) - 1)] + 1, 0)
                names = symbols[first] * (int(symbols.max()) + 2) + second
            self._add(symbols, starts, first, sizes, blocks)
            symbols = pd.factorize(names)[0].astype(np.int64)
            blocks = not blocks
        self.forward.append(Level(symbols, None, None, None, None))
        self.backward.append(Level(symbols[::-1], None, None, None, None))

    def _add(self, symbols, starts, first, sizes, blocks) -> None:
        n, m = len(symbols), len(first)
        parent = np.cumsum(starts) - 1
        ends = np.zeros(n, dtype=bool)
        ends[first + sizes - 1] = True
        last = (first + sizes)[parent] if blocks else None
        here = np.arange(n)
        self.forward.append(Level(symbols, last - here if blocks else None, starts, parent, first))
        self.backward.append(Level(symbols[::-1], (here - first[parent] + 1)[::-1] if blocks else None, ends[::-1],
                                   (m - 1 - parent)[::-1], (n - first - sizes)[::-1]))

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and j on."""
        return _extend(self.forward, i, j)

    def extend_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and j backwards, both included."""
        n = len(self.forward[0].symbols)
        return _extend(self.backward, n - 1 - i, n - 1 - j)


def _agree(level: Level, i: np.ndarray, j: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Move the queries `which` past their symbols where these agree; returns those that moved."""
    a, b = i[which], j[which]
    same = level.symbols[a] == level.symbols[b]
    moved = which[same]
    if len(moved):
        a, b = a[same], b[same]
        step = 1 if level.left is None else np.minimum(level.left[a], level.left[b])
        i[moved] = a + step
        j[moved] = b + step
    return moved


def _extend(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common extensions; the sequence must end with a symbol that occurs once,
    so that every extension ends at a difference, and i must differ from j."""
    origin = i
    i, j = i.astype(np.int64), j.astype(np.int64)
    stopped: list[np.ndarray] = []                       # by level: queries whose next symbols differ there
    climbing = np.arange(len(i))
    for level in levels:
        differ = []
        if level.starts is None:                         # the top: symbol by symbol
            while len(climbing):
                moved = _agree(level, i, j, climbing)
                differ.append(np.setdiff1d(climbing, moved, assume_unique=True))
                climbing = moved
        else:
            ready = []
            while len(climbing):
                aligned = level.starts[i[climbing]] & level.starts[j[climbing]]
                ready.append(climbing[aligned])
                rest = climbing[~aligned]
                moved = _agree(level, i, j, rest)
                differ.append(np.setdiff1d(rest, moved, assume_unique=True))
                climbing = moved
            climbing = np.concatenate(ready) if ready else climbing
            i[climbing] = level.parent[i[climbing]]
            j[climbing] = level.parent[j[climbing]]
        stopped.append(np.concatenate(differ) if differ else np.zeros(0, dtype=np.int64))
    down = stopped[-1]
    for h in range(len(levels) - 2, -1, -1):
        level = levels[h]
        i[down] = level.child[i[down]]
        j[down] = level.child[j[down]]
        moved = down
        while len(moved):
            moved = _agree(level, i, j, moved)
        down = np.concatenate((down, stopped[h]))
    return i - origin


def _grid(sizes: np.ndarray, offsets: np.ndarray, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid of all texts, in blocks; `periods` is the
    number of periods for which places of a run follow each other."""
    longest = sizes // (periods + 1)
    text = np.repeat(np.arange(len(sizes)), longest)
    q = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = periods * q
    count = -(-(sizes[text] - q) // step)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(text):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + GRID_BLOCK, side="right")))
        c = count[lo:hi]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(offsets[text[lo:hi]], c) + k * np.repeat(step[lo:hi], c), np.repeat(q[lo:hi], c)
        lo = hi


def runs_of(texts: list[list[bytes]], min_exponent: int = 4, min_length: int = 6) -> list[np.ndarray]:
    """For every list of words its runs, rows (start, length, period) by start, then period."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    empty = np.zeros((0, 3), dtype=np.int64)
    if not sizes.sum():
        return [empty] * len(texts)
    # separator, text, separator, text, ..., separator: a name of its own for each
    offsets = np.cumsum(sizes + 1) - sizes
    total = int(sizes.sum()) + len(texts) + 1
    names: dict[bytes, int] = {}
    separators = np.concatenate(([0], np.cumsum(sizes + 1)))
    word = np.ones(total, dtype=bool)
    word[separators] = False
    symbols = np.zeros(total, dtype=np.int64)
    symbols[word] = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64, int(sizes.sum()))
    symbols[separators] = len(names) + np.arange(len(separators))

    found = []
    for x, q in _grid(sizes, offsets, min_exponent - 1):
        hit = symbols[x] == symbols[x + q]
        x, q = x[hit], q[hit]
        near = (symbols[x + 1] == symbols[x + 1 + q]) | (symbols[x - 1] == symbols[x - 1 + q])
        near |= np.maximum((min_exponent - 1) * q, min_length - q) < 2       # a run of two words agrees at one place
        found.append((x[near], q[near]))
    x, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
    if not len(x):
        return [empty] * len(texts)
    grammar = Grammar(symbols, enough=2 * len(texts) + 64)
    back = grammar.extend_back(x - 1, x - 1 + q)
    start, length = x - back, back + grammar.extend(x, x + q) + q
    good = length >= np.maximum(min_length, min_exponent * q)
    rows = np.unique(np.stack((start[good], length[good], q[good]), axis=1), axis=0)
    if len(rows):                                        # of one stretch the smallest period comes first
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(offsets, rows[:, 0], side="right") - 1
    rows[:, 0] -= offsets[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that lie after the first period of a run, joined by spaces."""
    if len(runs):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(min_exponent: int, min_length: int):
    def judged(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts, min_exponent, min_length)
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t) for t in texts], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields),
             pa.array([collapse(t, r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())],
            names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in text_slices(batch.column(1), 4_000_000):
                held: list[list[bytes]] = []
                size = 0
                for k, t in enumerate(part):
                    words = t.encode().split()           # \x20 and \x09-\x0D
                    if held and size + len(words) > BATCH_WORDS:
                        yield judged(batch.column(0).slice(lo + k - len(held), len(held)), held)
                        held, size = [], 0
                    held.append(words)
                    size += len(words)
                yield judged(batch.column(0).slice(lo + len(part) - len(held), len(held)), held)

    return run


def periodic_runs(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: id (a column of any type), n_words, runs (array of start, length,
    period in words, by start, then period), collapsed (the text with one period of each run)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = (f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return rows.mapInArrow(_finder(min_exponent, min_length), out).withColumnRenamed("id", id_col)

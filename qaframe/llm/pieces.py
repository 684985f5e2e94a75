"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie
(operator 2).

A model is a list of pieces with log scores.  Encoding escapes spaces to the
marker U+2581, puts one before the text, and finds the segmentation of highest
total score; what no piece covers becomes byte pieces.  Decoding joins the
pieces, turns byte pieces back into UTF-8 and markers into spaces.

Where no piece crosses the start of a word, segments of a text are those of its
words, so each distinct word of a batch is segmented once and remembered in a
bounded memory.  The words of a batch are segmented together: the trie walk
advances all start positions by one byte at a time, and the Viterbi pass relaxes
one start position of every word per step.  Among equal scores the segmentation
whose last piece is longest wins.

The pieces of a model whose type is not Unigram have ranks instead of log
scores; `load_pieces` then takes the Zipf estimate -ln(rank + 2).

Defined results: a null or empty text has no ids and decodes to an empty text.
Texts that hold the marker itself decode to a space in its place.  Repeated rows are encoded row by
row, null ids kept; texts are encoded whole, however long; an empty table gives an empty
result.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.tokens import text_slices

MARK = "▁"
_MARK = MARK.encode()
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(" [ ]*[^ ]*")


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: str = "normal"            # normal, byte, or special (never produced)


def load_pieces(model_file: str) -> list[Piece]:
    """The pieces of a public model file."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores = [m.get_score(i) for i in range(m.get_piece_size())]
    ranks = all(s == int(s) for s in scores)
    out = []
    for i, s in enumerate(scores):
        special = m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        kind = "byte" if m.is_byte(i) else "special" if special else "normal"
        out.append(Piece(m.id_to_piece(i), -math.log(2 - s) if ranks else s, kind))
    return out


class DoubleArrayTrie:
    """Trie over bytes: the child of node s by byte c is base[s] + c, if check of
    that cell is s.  `value` of a node is the piece that ends there, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.value = np.full(size, -1, dtype=np.int32)
        self.check[0] = -2                           # taken, and nobody's child
        self.free_from = [1, 1]                      # where single children and families look for room
        todo = [(0, 0, len(keys), 0)] if keys else []      # node, key range, depth
        while todo:
            node, lo, hi, depth = todo.pop()
            while lo < hi and len(keys[lo][0]) == depth:
                self.value[node] = keys[lo][1]
                lo += 1
            children = []
            at = lo
            while at < hi:
                c = keys[at][0][depth]
                end = at
                while end < hi and keys[end][0][depth] == c:
                    end += 1
                children.append((c, at, end))
                at = end
            if not children:
                self.base[node] = -256               # no child is inside the arrays
                continue
            codes = np.array([c for c, _, _ in children])
            base = self._place(codes, 0 if len(codes) == 1 else 1)
            self.base[node] = base
            self.check[base + codes] = node
            todo += [(base + c, a, b, depth + 1) for c, a, b in children]
        self.depth = max((len(k) for k, _ in keys), default=0)

    def _place(self, codes: np.ndarray, kind: int) -> int:
        """A base for which all these children fall on free cells.  Families
        do not look again into regions where they found no room."""
        window = self.free_from[kind]
        while True:
            while window + 4096 + 512 >= len(self.check):
                self._grow()
            bases = np.flatnonzero(self.check[window:window + 4096] == -1) + window - codes[0]
            bases = bases[bases >= 0]
            fits = np.flatnonzero((self.check[bases[:, None] + codes] == -1).all(axis=1))
            if len(fits):
                base = int(bases[fits[0]])
                self.free_from[kind] = window if kind else base + int(codes[0])
                return base
            window += 4096

    def _grow(self) -> None:
        n = len(self.check)
        self.base = np.concatenate((self.base, np.zeros(n, dtype=np.int32)))
        self.check = np.concatenate((self.check, np.full(n, -1, dtype=np.int32)))
        self.value = np.concatenate((self.value, np.full(n, -1, dtype=np.int32)))

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that begin at the starts and end by the ends: (start, length, piece)."""
        out = []
        at, node, end = starts, np.zeros(len(starts), dtype=np.int64), ends
        for depth in range(self.depth):
            alive = at + depth < end
            at, node, end = at[alive], node[alive], end[alive]
            if not len(at):
                break
            cell = self.base[node] + data[at + depth].astype(np.int64)
            inside = (cell >= 0) & (cell < len(self.check))
            ok = np.zeros(len(cell), dtype=bool)
            ok[inside] = self.check[cell[inside]] == node[inside]
            at, node, end = at[ok], cell[ok], end[ok]
            piece = self.value[node]
            hit = piece >= 0
            out.append((at[hit], np.full(int(hit.sum()), depth + 1), piece[hit]))
        if not out:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(c) for c in zip(*out))


class UnigramModel:
    """Everything that encoding and decoding need; bounded by the vocabulary."""

    def __init__(self, pieces: list[Piece], remembered: int = 250_000):
        # multiples of 2^-20: sums are exact, so ties do not depend on rounding
        self.scores = np.round(np.array([p.score for p in pieces]) * 2.0 ** 20) / 2.0 ** 20
        normal = [(p.text.encode(), i) for i, p in enumerate(pieces) if p.kind == "normal"]
        self.trie = DoubleArrayTrie(normal)
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.surface: list[bytes] = []
        for i, p in enumerate(pieces):
            if p.kind == "byte":
                self.bytes[int(p.text[3:-1], 16)] = i
                self.surface.append(bytes([int(p.text[3:-1], 16)]))
            else:
                self.surface.append(p.text.replace(MARK, " ").encode() if p.kind == "normal" else b"")
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        self.is_byte[self.bytes] = True
        self.unknown = min((self.scores[i] for _, i in normal), default=0.0) - UNKNOWN_PENALTY
        # a word can be segmented alone if markers only lead a piece
        self.by_word = not any(MARK in p.text.lstrip(MARK) for p in pieces if p.kind == "normal")
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # ---- encoding

    def segment(self, words: list[bytes]) -> list[np.ndarray]:
        """Best ids of each escaped byte string."""
        if not words:
            return []
        data = np.frombuffer(b"\n".join(words) + b"\n", dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        chars = np.flatnonzero((data & 0xC0) != 0x80)      # starts of characters, and separators
        word_of = np.searchsorted(ends, chars)
        inner = chars < ends[word_of]
        starts, of = chars[inner], word_of[inner]
        char_len = np.diff(np.append(chars, len(data)))[inner]
        at, length, piece = self.trie.walk(data, starts, ends[of])
        # a character that no piece covers alone may become bytes
        alone = np.zeros(len(data), dtype=bool)
        alone[at[length == char_len[np.searchsorted(starts, at)]]] = True
        bare = ~alone[starts]
        at = np.concatenate((at, starts[bare]))
        length = np.concatenate((length, char_len[bare]))
        score = np.concatenate((self.scores[piece], np.full(int(bare.sum()), self.unknown)))
        piece = np.concatenate((piece, np.full(int(bare.sum()), -1, dtype=np.int64)))
        # relax the edges of one start position of all words at a time
        offset = at - begins[np.searchsorted(ends, at)]
        order = np.argsort(offset, kind="stable")
        at, length, score, piece, offset = at[order], length[order], score[order], piece[order], offset[order]
        steps = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1]))) if len(offset) else np.zeros(0, int)
        best = np.full(len(data) + 1, -np.inf)
        best[begins] = 0.0
        back = np.full(len(data) + 1, -1, dtype=np.int64)
        for lo, hi in zip(steps, np.append(steps[1:], len(offset))):
            reach = at[lo:hi] + length[lo:hi]
            total = best[at[lo:hi]] + score[lo:hi]
            better = total > best[reach]
            best[reach[better]] = total[better]
            back[reach[better]] = np.arange(lo, hi)[better]
        chosen = []
        where = ends[lengths > 0]
        first = begins[lengths > 0]
        while len(where):
            edge = back[where]
            chosen.append(edge)
            where = at[edge]
            more = where > first
            where, first = where[more], first[more]
        edges = np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
        edges = edges[np.argsort(at[edges])]
        # byte fallback: one id per byte of an uncovered character
        count = np.where(piece[edges] < 0, length[edges], 1)
        ids = np.repeat(piece[edges], count)
        fall = np.flatnonzero(ids < 0)
        if len(fall):
            first_at = np.repeat(at[edges] - (np.cumsum(count) - count), count)
            ids[fall] = self.bytes[data[(first_at + np.arange(len(ids)))[fall]]]
        borders = np.searchsorted(at[edges], ends)
        cuts = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], borders))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _learn(self, words: set[str]) -> None:
        need = words.difference(self.young)
        if len(self.young) + len(need) > self.remembered:
            self.old, self.young = self.young, {}
            need = words
        known = need & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        fresh = sorted(need - known, key=len)
        lo = 0
        while lo < len(fresh):                               # words of like lengths take like numbers of steps
            hi, size = lo, 0
            while hi < len(fresh) and size < 1_000_000:
                size += len(fresh[hi]) + 4
                hi += 1
            part = fresh[lo:hi]
            escaped = [_MARK + w.replace(" ", MARK).encode("utf-8", "replace") for w in part]
            self.young.update(zip(part, (i.astype("<u4").tobytes() for i in self.segment(escaped))))
            lo = hi

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            escaped = [(MARK + t.replace(" ", MARK)).encode("utf-8", "replace") if t else b"" for t in texts]
            return [i.astype("<u4").tobytes() for i in self.segment(escaped)]
        split = []
        for t in texts:
            if MARK in t:                        # reads as a space, also in a run of them
                t = t.replace(MARK, " ")
            if not t:
                split.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                split.append([w[1:] for w in _WORD.findall(" " + t)])
            else:
                split.append(t.split(" "))
        self._learn(set().union(*split))
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in split]

    # ---- decoding

    def decode(self, ids: bytes) -> str:
        """Text of little-endian unsigned 32-bit ids, without the leading marker."""
        joined = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        # a marker that is no piece of the model came as bytes
        return joined.replace(_MARK, b" ").decode("utf-8", "replace").removeprefix(" ")


_MODELS: dict[str, UnigramModel] = {}


def model_of(model_file: str) -> UnigramModel:
    """The model of this worker process."""
    if model_file not in _MODELS:
        _MODELS[model_file] = UnigramModel(load_pieces(model_file))
    return _MODELS[model_file]


def _encoder(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), 2_000_000):
                ids = model.encode(texts)
                fallback = [int(model.is_byte[np.frombuffer(i, "<u4")].sum()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array(ids, pa.binary()), pa.array(fallback, pa.int64())],
                    names=["id", "ids", "n_bytes"])
    return run


def _decoder(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [model.decode(i or b"") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])
    return run


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (little-endian unsigned 32-bit), n_bytes (ids that are byte pieces)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(model_file), "id long, ids binary, n_bytes long").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id (a column of any type), text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoder(model_file), f"id {kind}, text string").withColumnRenamed("id", id_col)

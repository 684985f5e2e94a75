"""Token ids of whole texts by a public tokenizer file.

`ChunkEncoder` encodes a text as the concatenation of its space-separated
chunks: byte-level and word-end BPE never merge across a space that starts a new
word, so the ids equal those of the whole text.  Two kinds of text are encoded
whole: those with three white-space characters in a row around a space, the one
case in which a chunk's ids depend on its neighbour, and those that hold the
string of an added (special) token, which the library cuts out first.

A chunk of Latin letters, ASCII symbols but the apostrophe, and single line breaks
inside it is cut further where the kind of its characters changes, as every pattern
of these vocabularies cuts it.  Any other chunk stays one piece.  In both cases the
ids of a text are the library's ids of its pieces, each with the space before it.

The texts of a call are cut by numpy over their bytes, and Arrow numbers the distinct
pieces; only these go to the library, words of letters to its model without the text
pipeline, which costs more than the model.  Thousands go in one call and are parted by
the ids themselves: a piece behind a space of a byte-level vocabulary has one id that
begins with the space; a word of a word-end vocabulary has one id that ends it, and
between its other pieces stands a private-use character.  Where the count does not
come out, and for pieces with white space at an end, they are encoded one by one.

Pieces met twice in a call are remembered with their ids, so text that never repeats
leaves the memory alone.  The memory is bounded in bytes: when it is full, only the
pieces of the present call stay.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNSAFE = re.compile(r"\s \s")
SIGN = "\ue000"                  # a private-use character, put between pieces
REMEMBERED_BYTES = 8 << 20       # of remembered pieces and their ids
TOGETHER = 8192                  # pieces in one call of the library
# characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_CHAR_OF_BYTE = np.array([_BYTE_CHARS.get(b, b) for b in range(256)], dtype="<u2")
# kinds of bytes; the two bytes of a Latin letter (U+00C0 to U+024F) are letters
LETTER, SPACE, BREAK, SYMBOL, OTHER = 1, 2, 4, 8, 16
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[[*map(ord, string.ascii_letters), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
_KIND[[ord(c) for c in string.punctuation if c != "'"]] = SYMBOL
_KIND[[ord(" "), ord("\n")]] = SPACE, BREAK
# bytes that may end, and begin, a white-space character
_SPACE_END, _SPACE_BEGIN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE_END[[*range(0x21), *range(0x80, 0xC0)]] = True
_SPACE_BEGIN[[*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_PER_PROCESS: dict[tuple[str, int], "ChunkEncoder"] = {}


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of every byte of a text in UTF-8."""
    kinds = _KIND[data]
    two = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
    if len(two):
        code = (data[two] & 0x1F).astype(np.uint16) << 6 | data[two + 1] & 0x3F
        # the two signs among the letters, the capital I with a dot, whose small form is two characters, and what lies behind
        kinds[two[(code == 0xD7) | (code == 0xF7) | (code == 0x130) | (code > 0x24F)]] = OTHER
    return kinds


def cut_pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that lie one after another; `starts`: the first
    bytes of the texts (none of them empty)."""
    kinds = _kinds(data)
    chunk = kinds == SPACE
    chunk[starts] = True
    breaks = np.flatnonzero(kinds == BREAK)
    if len(breaks):                                  # a line break stays between two characters of one chunk
        inner = (breaks > 0) & (breaks < len(data) - 1)
        inner[inner] = ((kinds[breaks[inner] - 1] | kinds[breaks[inner] + 1]) & ~np.uint8(LETTER | SYMBOL)) == 0
        inner[inner] = ~(chunk[breaks[inner]] | chunk[breaks[inner] + 1])
        kinds[breaks[~inner]] = OTHER
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != SPACE)
    other = np.flatnonzero(kinds == OTHER)
    if len(other):                                   # their chunks are not cut
        at = np.flatnonzero(chunk)
        uncut = np.zeros(len(at), dtype=bool)
        uncut[np.searchsorted(at, other, side="right") - 1] = True
        cut &= ~np.repeat(uncut, np.diff(at, append=len(data)))
    return np.flatnonzero(cut | chunk)


def _bytes_of(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, and the bounds of each."""
    if not len(pieces):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = pieces.buffers()
    bounds = np.frombuffer(ends, np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def _pieces_of(data: np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)])


NONE = _pieces_of(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _spread(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of stretches, each given by its start and count, one after another."""
    before = np.cumsum(counts) - counts
    return ids[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))]


class ChunkEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one task, one thread
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.word_end = bool(suffix)
        self.sign = next(iter(self.tokenizer.encode_batch_fast([SIGN], add_special_tokens=False))).ids
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)     # ids that begin with a space
        self.begins[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.closes = np.zeros(len(self.begins), dtype=bool)            # ids that end a word
        self.closes[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.space = vocab.get("\u0120")
        self.model = self.tokenizer.model
        self.words = Tokenizer(self.model)                              # the model alone: words between white space
        self.words.pre_tokenizer = WhitespaceSplit()
        self.remembered = remembered
        self.known = NONE                                # remembered pieces
        self.ids = np.zeros(0, dtype="<u4")              # their ids, one piece after another
        self.counts = np.zeros(0, dtype=np.int64)

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED_BYTES) -> "ChunkEncoder":
        """The encoder of this worker process; workers are reused over tasks."""
        key = (path, remembered)
        if key not in _PER_PROCESS:
            _PER_PROCESS[key] = cls(path, remembered)
        return _PER_PROCESS[key]

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[lo:lo + 4096], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _together(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pieces of any characters, of a byte-level vocabulary each with its space."""
        for lo in range(0, len(pieces), TOGETHER):
            part = pieces[lo:lo + TOGETHER]
            text = (f" {SIGN} " if self.word_end else "").join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            if self.word_end:                            # cut out the signs between pieces
                at = np.flatnonzero(ids == self.sign[0])
                starts = np.concatenate(([0], at + len(self.sign)))
                ends = np.concatenate((at, [len(ids)]))
                good = SIGN not in "".join(part) and all((ids[at + k] == s).all() for k, s in enumerate(self.sign))
            else:
                starts = np.flatnonzero(self.begins[ids])
                ends = np.concatenate((starts[1:], [len(ids)]))
                good = True
            if not good or len(starts) != len(part):
                yield from self._plain(part)
                continue
            data = ids.tobytes()
            yield from [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]

    def _encode_words(self, words: pa.LargeBinaryArray, space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of words of Latin letters, `space`: all with a space before them.

        Thousands go to the model in one call, parted at white space, and their ids are
        parted by the ids themselves: the id that begins with the space, the id that ends
        a word, or the id of the space put between words that have none.  Where the count
        does not come out, they go to the model one by one."""
        out = [(np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))]
        led = space and not self.word_end                # a word-end vocabulary has no ids for the space
        for lo in range(0, len(words), TOGETHER):
            data, bounds = _bytes_of(words[lo:lo + TOGETHER])
            n = len(bounds) - 1
            if not space:
                data = np.insert(data, bounds[:-1], ord(" "))
            if self.word_end:
                data = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
            plain = _CHAR_OF_BYTE[data].tobytes().decode("utf-16-le")
            text = plain.replace("\u0120", "\n\u0120" if led else "\n" if self.word_end else "\n\u0120\n")
            ids = np.array(self.words.encode_batch_fast([text if led or self.word_end else text[3:]],
                                                        add_special_tokens=False)[0].ids, dtype="<u4")
            if led:
                starts = np.flatnonzero(self.begins[ids])
                ends = np.concatenate((starts[1:], [len(ids)]))
            elif self.word_end:
                ends = np.flatnonzero(self.closes[ids]) + 1
                starts = np.concatenate(([0], ends[:-1]))
            else:
                at = np.flatnonzero(ids == self.space)
                starts = np.concatenate(([0], at + 1))
                ends = np.concatenate((at, [len(ids)]))
            if len(starts) == len(ends) == n and (starts < ends).all() and starts[0] == 0 and ends[-1] == len(ids):
                out.append((ids if led or self.word_end else ids[ids != self.space], ends - starts))
            else:
                lead = "\u0120" if led else ""
                single = [[t.id for t in self.model.tokenize(lead + w)] for w in plain.split("\u0120")[1:]]
                out.append((np.array([i for s in single for i in s], dtype="<u4"), np.array([len(s) for s in single], dtype=np.int64)))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([counts for _, counts in out])

    def _encode_others(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of pieces of any characters."""
        texts = [p.decode() for p in pieces.to_pylist()]
        if self.word_end:
            joined = texts
        else:
            joined = [t for t in texts if t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace()]
        ids = dict(zip(joined, self._together(joined)))
        alone = [t for t in texts if t not in ids]
        ids.update(zip(alone, self._plain(alone)))
        found = [ids[t] for t in texts]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], dtype=np.int64)

    def _encode_pieces(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces and their counts."""
        if not len(pieces):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        data, bounds = _bytes_of(pieces)
        kinds = np.bitwise_or.reduceat(_kinds(data), bounds[:-1])       # no piece is empty
        groups = [(kinds == LETTER | SPACE, lambda p: self._encode_words(p, True)),
                  (kinds == LETTER, lambda p: self._encode_words(p, False)),
                  ((kinds != LETTER | SPACE) & (kinds != LETTER), self._encode_others)]
        parts, at = [], 0
        starts, counts = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        for chosen, encode in groups:
            ids, n = encode(pieces.filter(pa.array(chosen)))
            starts[chosen], counts[chosen] = at + np.cumsum(n) - n, n
            parts.append(ids)
            at += len(ids)
        return _spread(np.concatenate(parts), starts, counts), counts

    def _ids_of(self, pieces: pa.LargeBinaryArray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each distinct piece's start and count in them; `times`: how often it was met."""
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        met = at.drop_null().to_numpy()
        fresh = pieces.filter(pa.array(new))
        new_ids, new_counts = self._encode_pieces(fresh)
        counts_all = np.concatenate((self.counts, new_counts))
        ids_all = np.concatenate((self.ids, new_ids))
        starts_all = np.cumsum(counts_all) - counts_all
        place = np.zeros(len(pieces), dtype=np.int64)
        place[~new] = met
        place[new] = len(self.known) + np.arange(len(fresh))
        starts, counts = starts_all[place], counts_all[place]
        self._remember(pieces, times, new, ids_all, starts, counts)
        return ids_all, starts, counts

    def _remember(self, pieces: pa.LargeBinaryArray, times: np.ndarray, new: np.ndarray, ids: np.ndarray,
                  starts: np.ndarray, counts: np.ndarray) -> None:
        def size(held: pa.LargeBinaryArray, n_ids: int) -> int:
            return int(_bytes_of(held)[1][-1]) + 16 * len(held) + 4 * n_ids

        again = new & (times > 1)
        if not again.any():
            return
        more = pieces.filter(pa.array(again))
        if size(self.known, len(self.ids)) + size(more, int(counts[again].sum())) <= self.remembered:
            self.known = pa.concat_arrays([self.known, more])
            self.ids = np.concatenate((self.ids, _spread(ids, starts[again], counts[again])))
            self.counts = np.concatenate((self.counts, counts[again]))
            return
        again |= ~new                                    # full: of what is remembered, that met now stays
        stay = pieces.filter(pa.array(again))
        if size(stay, int(counts[again].sum())) <= self.remembered:
            self.known, self.ids, self.counts = stay, _spread(ids, starts[again], counts[again]), counts[again]
        else:
            self.known, self.ids, self.counts = NONE, self.ids[:0], self.counts[:0]

    def _whole(self, texts: list[str], data: np.ndarray) -> list[int]:
        """Numbers of the texts that are encoded whole."""
        spaces = np.flatnonzero(data[1:-1] == ord(" ")) + 1
        unsafe = bool((_SPACE_END[data[spaces - 1]] & _SPACE_BEGIN[data[spaces + 1]]).any())
        low = data.tobytes().lower()
        special = any(not s.isascii() or s.encode() in low for s in self.special)
        if not unsafe and not special:                   # in none of them
            return []
        return [i for i, t in enumerate(texts) if unsafe and _UNSAFE.search(t)
                or special and any(s in t.lower() for s in self.special)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        texts = list(texts)
        out = [b""] * len(texts)
        column = pa.array(texts, pa.large_string()).cast(pa.large_binary())
        whole = self._whole(texts, _bytes_of(column)[0])
        if whole:
            for i in whole:
                out[i] = next(self._plain([texts[i]]))
            cut = np.ones(len(texts), dtype=bool)
            cut[whole] = False
            column = column.filter(pa.array(cut))
            numbers = np.flatnonzero(cut).tolist()
        else:
            numbers = range(len(texts))
        data, bounds = _bytes_of(column)
        if not len(data):
            return out
        starts = cut_pieces(data, bounds[:-1][np.diff(bounds) > 0])
        pieces = _pieces_of(data, np.append(starts, len(data))).dictionary_encode()
        codes = pieces.indices.to_numpy()
        ids, at, counts = self._ids_of(pieces.dictionary, np.bincount(codes, minlength=len(pieces.dictionary)))
        each = counts[codes]
        found = _spread(ids, at[codes], each).tobytes()
        ends = np.append(0, np.cumsum(4 * each))[np.searchsorted(starts, bounds)].tolist()
        for i, a, b in zip(numbers, ends, ends[1:]):
            out[i] = found[a:b]
        return out


def text_slices(column: pa.Array, max_bytes: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Cut an Arrow column of texts into slices of bounded bytes, of which only one
    at a time is a list of Python strings; a null text is empty.  A text beyond
    the bound is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(column)
    while lo < n:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi

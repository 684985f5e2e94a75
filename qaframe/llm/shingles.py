"""Word shingles, set keys and MinHash signatures of whole batches of texts.

A word is a maximal run of non-white-space bytes with A-Z lower-cased.  Words
are hashed by differences of one running polynomial sum over the batch, with a
random 64-bit value per byte, and k words are mixed to a 64-bit shingle hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13 | 1          # odd, 3 modulo 8: its powers are invertible
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
for _c in range(65, 91):                # A-Z count as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ws = _IS_WS[data]
    change = np.flatnonzero(ws[1:] != ws[:-1]) + 1
    if not ws[0]:
        change = np.concatenate(([0], change))
    begin, end = change[0::2], change[1::2]
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up, out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    borders = np.cumsum([len(p) + 1 for p in parts])
    upto = np.searchsorted(begin, borders)
    return hashes, np.diff(np.concatenate(([0], upto)))


def _combine(columns: list[np.ndarray], seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.full(len(columns[0]), seed, dtype=np.uint64)
        for c in columns:
            acc = (acc ^ c) * _U(0x9FB21C651E98DF25)
            acc ^= acc >> _U(29)
        return mix(acc)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of text i are
    hashes[offsets[i]:offsets[i+1]].  A text of fewer than k words has its whole
    word sequence as one shingle; a text without words has none."""
    words, counts = word_hashes(texts)
    starts = np.concatenate(([0], np.cumsum(counts)))
    n = len(words)
    windows = _combine([words[j:n - k + 1 + j] for j in range(k)], k) if n >= k else np.zeros(0, dtype=np.uint64)
    sets = []
    for i, c in enumerate(counts):
        lo = starts[i]
        if c >= k:
            s = np.sort(windows[lo:lo + c - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif c:
            sets.append(_combine([words[lo + j:lo + j + 1] for j in range(c)], 1000 + c))
        else:
            sets.append(words[:0])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else words[:0]), offsets


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums per set: together they identify it."""
    with np.errstate(over="ignore"):
        out = []
        for seed in (0x51ED270B0A5EC4F1, 0xD6E8FEB86659FD93):
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes + _U(seed)))))
            out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


@dataclass(frozen=True)
class Bands:
    """`bands` bands of `rows` minima: a pair of similarity s meets in some band
    with probability 1 - (1 - s^rows)^bands; 30 bands of 5 miss 7 in a million
    pairs at 0.8 and fewer above."""
    bands: int = 30
    rows: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def signatures(hashes: np.ndarray, offsets: np.ndarray, b: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(minima as uint32, band keys as uint64), a row per non-empty set.

    The hash functions are multiply-add-shift on 32 bits of the shingle hash, a
    strongly universal family."""
    rng = np.random.default_rng(977)
    a = rng.integers(0, 1 << 63, size=b.hashes, dtype=np.uint64) * _U(2) + _U(1)
    c = rng.integers(0, 1 << 63, size=b.hashes, dtype=np.uint64)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    minima = np.zeros((len(filled), b.hashes), dtype=np.uint32)
    with np.errstate(over="ignore"):
        x = hashes >> _U(32)
        at = offsets[:-1][filled]
        for h in range(b.hashes if len(filled) else 0):
            minima[:, h] = np.minimum.reduceat(((x * a[h] + c[h]) >> _U(32)).astype(np.uint32), at)
    keys = np.zeros((len(filled), b.bands), dtype=np.uint64)
    for band in range(b.bands):
        keys[:, band] = _combine([minima[:, band * b.rows + r].astype(np.uint64) for r in range(b.rows)], band + 1)
    return minima, keys

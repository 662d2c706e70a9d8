"""Vectorised tokens and rolling hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from ._arrow import slices

_U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants of a seed."""
    start = (seed * 0xD1342543DE82EF95) & (2**64 - 1)
    return mix(np.arange(1, n + 1, dtype=_U) * _U(GOLDEN) + _U(start)) | _U(1)


_PLACE = constants(4096, 1)
_LENGTH = _U(0xA24BAED4963EE407)

#: White space is x20 and x09 to x0D, as in the contract of the word operators.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)

#: Classes by byte: 0 separates, equal neighbours of another class form one token.
WORDS = np.where(SPACE, 0, 1).astype(np.uint8)
LETTERS = np.where(_LETTER | _DIGIT, 1, 0).astype(np.uint8)
PARTS = np.where(SPACE, 0, np.where(_LETTER | _DIGIT, 1, 2)).astype(np.uint8)

#: Values by byte that a token's hash sums.
EXACT = (_BYTES + 1).astype(_U)
LOWER = (np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES) + 1).astype(_U)


def runs(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents) of the tokens: longest stretches of one class within one document."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    c = classes[buf]
    first = np.empty(len(c), bool)
    first[0] = True
    np.not_equal(c[1:], c[:-1], out=first[1:])
    heads = off[:-1]
    first[heads[heads < len(c)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(c))
    keep = c[starts] != 0
    starts, ends = starts[keep], ends[keep]
    counts = np.diff(np.searchsorted(starts, off))
    return starts, ends, np.repeat(np.arange(len(off) - 1), counts)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = EXACT, lead: int = 0) -> np.ndarray:
    """A 64-bit hash of each token's bytes after fold; with lead, of its first bytes only."""
    n = len(starts)
    if not n:
        return np.empty(0, _U)
    a, b = int(starts[0]), int(ends[-1])
    step = np.empty(n, np.int64)
    step[:-1] = starts[1:] - starts[:-1]
    step[-1] = b - starts[-1]
    place = np.arange(a, b) - np.repeat(starts, step)
    length = ends - starts
    inside = place < np.repeat(np.minimum(length, lead) if lead else length, step)
    place &= 4095
    value = fold[buf[a:b]]
    value *= _PLACE[place]
    value *= inside
    total = np.add.reduceat(value, starts - a)
    return mix(total + (np.minimum(length, lead) if lead else length).astype(_U) * _LENGTH)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all white-space separated words, number of words of each document)."""
    parts, counts = [np.empty(0, _U)], [np.empty(0, np.int64)]
    for i, j in slices(off):
        own = off[i : j + 1] - off[i]
        sub = buf[off[i] : off[j]]
        starts, ends, doc = runs(sub, own, WORDS)
        parts.append(hashes(sub, starts, ends))
        counts.append(np.bincount(doc, minlength=j - i))
    return np.concatenate(parts), np.concatenate(counts).astype(np.int64)


def grams(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hashes of all k consecutive entries (empty if there are fewer)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, _U)
    c = constants(k, seed)
    total = h[:m] * c[0]
    for j in range(1, k):
        total += h[j : j + m] * c[j]
    return mix(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w entries, by doubling."""
    size, out = 1, x
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        size += step
    return out


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First positions of the groups of equal keys in sorted order."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)

"""Hashed word shingles of whole texts, on the executors."""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_LETTER = np.arange(1, 257, dtype=np.uint64)
_LETTER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose hashes are added up together.
_WINDOW = 1 << 18
_POWERS = _INVERSES = np.ones(1, dtype=np.uint64)
_PLACE = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each bit of a 64-bit hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        _POWERS, _INVERSES = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
    return _POWERS, _INVERSES


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z as a-z.

    A word's hash is that of the polynomial of its bytes, which is a difference of running sums.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    starts, ends = edge[::2], edge[1::2]
    value = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(int(np.searchsorted(ends, base + _WINDOW, side="right")), lo + 1)
        part = raw[base : ends[hi - 1]]
        powers, inverses = _powers(len(part))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[part] * powers[: len(part)])])
        at = starts[lo:hi] - base
        value[lo:hi] = (sums[ends[lo:hi] - base] - sums[at]) * inverses[at]
        lo = hi
    return starts, mixed(value + (ends - starts).astype(np.uint64))


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_hashes(text: str | None) -> np.ndarray:
    return word_spans(utf8(text))[1]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles. With fewer words the whole sequence is
    the one shingle; without words there is none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    if n < size:
        return mixed((words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[: n - size + 1] * _PLACE[0]
    for i in range(1, size):
        total = total + words[i : n - size + 1 + i] * _PLACE[i]
    return np.unique(mixed(total))

"""Words and word shingles of whole batches of texts, as 64-bit fingerprints.

A word is a run of digits, ASCII letters (lower-cased) and characters outside
ASCII. Words never cross rows.
"""

from __future__ import annotations

import numpy as np

from tokenmill.llm.common import Powers, byte_values, mixed

# lower-cased byte of a word, or 0 for a byte between words
LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        LOWER[_c] = _c
    elif 0x41 <= _c <= 0x5A:
        LOWER[_c] = _c + 32
_VALUES = byte_values(3)
_POWERS = Powers(0x5851F42D4C957F2D)


def word_bytes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of every word of all rows, and the byte behind its last."""
    word = LOWER[raw] > 0
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    starts[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def fingerprint_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words of all rows, and each row's word offsets."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s, e = word_bytes(raw, off)
    up, down = _POWERS.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[LOWER[raw]] * up[:len(raw)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h ^= (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h, np.searchsorted(s, off)


SHINGLE_WORDS = 5
_STEP = np.uint64(0x2545F4914F6CDD1D)


def shingles(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of every ``k``-word shingle, in row order. A row of
    fewer words, but not none, is one shingle."""
    h, wo = fingerprint_words(raw, off)
    n = np.diff(wo)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - wo[row]
    size = np.minimum(n, k)
    first = at + size[row] <= n[row]
    s, row = np.flatnonzero(first), row[first]
    with np.errstate(over="ignore"):
        out = np.zeros(len(s), np.uint64)
        for j in range(k):
            use = j < size[row]
            w = h[np.minimum(s + j, max(len(h) - 1, 0))] if len(h) else h
            out = np.where(use, out * _STEP + w, out)
    return row, mixed(out, 11)

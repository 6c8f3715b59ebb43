"""Word shingles of texts as 64-bit hashes, computed for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case, split at space and 09 to 0D), and each row's first word."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    begin = ~space
    begin[1:] &= space[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = ~space[heads]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), first
    stretch = np.diff(starts, append=len(data))
    within = np.arange(int(starts[0]), len(data)) - np.repeat(starts, stretch)
    part = low[starts[0] :].astype(np.uint64) + np.uint64(1)
    part[space[starts[0] :]] = 0
    powers = np.cumprod(np.full(int(stretch.max()), _P, np.uint64))
    # Text before a word's row ends is white space only, so it adds nothing to the word.
    return mix(np.add.reduceat(part * powers[within], starts - starts[0])), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Each row's distinct shingles in ascending order; a row of fewer words has its whole sequence as one, none without words."""
    words, first = word_hashes(data, offsets)
    n = len(words)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        total += mix(words[k : k + len(total)] + np.arange(k, k + 1, dtype=np.uint64) * _P)
    total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            place = np.arange(b - a, dtype=np.uint64) + np.uint64(101 * (b - a))
            out.append(mix(mix(words[a:b] + place * _P).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out

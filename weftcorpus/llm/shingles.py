"""64-bit hashes of word shingles, for whole blocks of texts at once.

Words are separated by ASCII white space and lower-cased for A-Z only. A text
with fewer words than the width has one shingle of all of them.
"""

from __future__ import annotations

import numpy as np

from weftcorpus.llm.common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def text_blocks(data: np.ndarray, at: np.ndarray, most: int = 1 << 19):
    """(first, last, bytes, offsets) of runs of texts of about `most` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    space = _SPACE[data]
    first = np.ones(n, bool)
    first[1:] = space[:-1]
    first[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(first & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    which = np.cumsum(np.bincount(starts, minlength=n)) - 1
    place = np.arange(n) - starts[np.maximum(which, 0)]
    place[: starts[0]] = 0
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _BASE, np.uint64))
    term = _BYTE[low] * powers[place]
    term[space] = 0
    sums = np.add.reduceat(term, starts)
    length = np.add.reduceat((~space).astype(np.uint64), starts)
    return mix64(sums + mix64(length)), np.searchsorted(at, starts, "right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    n = len(at) - 1
    h, doc = _words(data, at)
    if not len(h):
        return [np.zeros(0, np.uint64)] * n
    per = np.bincount(doc, minlength=n)
    start = np.concatenate([[0], np.cumsum(per)])
    if len(h) >= width:
        s = np.zeros(len(h) - width + 1, np.uint64)
        salt = np.arange(1, width + 1, dtype=np.uint64) * _BASE
        for j in range(width):
            s += mix64(h[j : len(h) - width + 1 + j] + salt[j])
        s = mix64(s)
    out = []
    for i in range(n):
        k = per[i]
        if k >= width:
            out.append(np.unique(s[start[i] : start[i + 1] - width + 1]))
        elif k:
            x = h[start[i] : start[i + 1]]
            out.append(mix64(np.array([mix64(x + np.arange(1, k + 1, dtype=np.uint64) * _BASE).sum(dtype=np.uint64) ^ np.uint64(k)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

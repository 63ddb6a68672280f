"""Sentences and hashed words of many texts at once, as arrays.

They are those that toxicity's sentences() and features() give text by text: word
characters come from the same pattern, a word's hashes are CRC-32 by bytes, all words
side by side. A prefix's hash differs from the state of the word's own hash there by
a constant of its length, as CRC is linear.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np

BUCKETS = 1 << 20
#: The beginnings of a word that are features, in code points.
STEMS = (4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"\w+")
_ENDS = re.compile(r"[.!?\n]+")
#: Bytes of words that are hashed side by side; longer ones are hashed one by one.
_SHORT = 48


@lru_cache(1 << 12)
def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings, so that stems count in inflected words."""
    out = [zlib.crc32(b"=" + word.encode())]
    out += [zlib.crc32(b"%d" % k + word[:k].encode()) for k in STEMS if len(word) >= k]
    return [x % BUCKETS for x in out]


def sentences(text: str):
    """(start, end, distinct lower-case words) of each sentence that has a word."""
    for m in _SENTENCE.finditer(text):
        if words := set(_WORD.findall(m[0].lower())):
            yield m.start(), m.end(), words


@lru_cache(2)
def _word_characters(wide: bool) -> np.ndarray:
    """Whether a code point is one of a word, for those below 2^16 or for all."""
    out = np.zeros(0x110000 if wide else 0x10000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, len(out))]))
    out[np.frombuffer("".join(_WORD.findall(every)).encode("utf-32-le"), np.uint32)] = True
    return out


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The step for each byte, and what tells a stem's hash from the word's by stem and bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    apart = [[zlib.crc32(b"%d" % k + bytes(n)) ^ zlib.crc32(b"=" + bytes(n)) for n in range(4 * STEMS[-1] + 1)] for k in STEMS]
    return step, np.array(apart, np.uint32)


def hashed(text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The features() of the words between start and end, a row each, filled up with BUCKETS."""
    step, apart = _crc_tables()
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(points):
        at = np.arange(len(points) + 1)
    else:
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
    size = at[end] - at[start]
    order = np.argsort(np.minimum(size, _SHORT + 1).astype(np.int16), kind="stable")[::-1]
    order = order[np.searchsorted(-size[order], -_SHORT) :]
    begin, length, n = start[order], size[order], len(order)
    first, chars = at[begin], end[order] - begin
    state = np.full(n, zlib.crc32(b"=") ^ 0xFFFFFFFF, np.uint32)
    seen = np.empty((4 * STEMS[-1] + 1, n), np.uint32)
    more = n - np.searchsorted(length[::-1], np.arange(_SHORT + 1), "right")
    for i, k in enumerate(more[: length[0] if n else 0].tolist()):
        now = state[:k]
        now[:] = step.take(now.astype(np.uint8) ^ raw[i:].take(first[:k])) ^ (now >> np.uint32(8))
        if i + 1 < len(seen):
            seen[i + 1, :k] = now
    low = np.uint32(BUCKETS - 1)
    out = np.full((len(start), 1 + len(STEMS)), BUCKETS, np.int32)
    out[order, 0] = ~state & low
    for j, k in enumerate(STEMS):
        has = np.flatnonzero(chars >= k)
        n_bytes = at[begin[has] + k] - first[has]
        out[order[has], j + 1] = (~seen[n_bytes, has] ^ apart[j][n_bytes]) & low
    for i in np.flatnonzero(size > _SHORT).tolist():
        own = features(text[start[i] : end[i]])
        out[i, : len(own)] = own
    return out


def pieces(texts: list, most: int = 1 << 18):
    """(rows, starts, strings) with about `most` characters each: whole texts, and long ones cut between sentences."""
    rows, starts, out, held = [], [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            cut = len(text) if len(text) - at <= most else m.end() if (m := _ENDS.search(text, at + most)) else len(text)
            if held and held + cut - at > most:
                yield rows, starts, out
                rows, starts, out, held = [], [], [], 0
            rows.append(row)
            starts.append(at)
            out.append(text[at:cut])
            held += cut - at
            at = cut
    if out:
        yield rows, starts, out


def lowered(text: str) -> str:
    """Lower case sentence by sentence; only a sigma's depends on what stands around it."""
    return _SENTENCE.sub(lambda m: m[0].lower(), text) if "Σ" in text else text.lower()


class Piece:
    """Of the texts of a piece, in order: row, start and end (in code points) of each sentence that
    has a word; the sentence (`of`) and the features() of each word; word(i) is the i-th in lower case."""

    def __init__(self, rows: list, starts: list, texts: list):
        low = [lowered(t) for t in texts]
        self.text = "\n".join(low)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        known = _word_characters(bool(len(points) and points.max() > 0xFFFF))
        edges = np.flatnonzero(np.diff(known[points], prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        ends = (points == 10) | (points == 33) | (points == 46) | (points == 63)
        begins = np.flatnonzero(np.diff(ends, prepend=True, append=True))[::2]
        segment = np.searchsorted(begins, self.start, "right") - 1
        fresh = np.diff(segment, prepend=-1) > 0
        self.of, segment = np.cumsum(fresh) - 1, segment[fresh]
        base = np.cumsum([0] + [len(t) + 1 for t in low])
        place = np.searchsorted(base, begins[segment], "right") - 1
        self.sentence_row, shift = np.array(rows, np.int64)[place], np.array(starts, np.int64)[place] - base[place]
        self.sentence_start = begins[segment] + shift
        self.sentence_end = np.minimum(np.append(begins, base[-1])[segment + 1], base[place + 1] - 1) + shift
        for i, (a, t) in enumerate(zip(starts, texts)):
            if len(t) != len(low[i]):  # one letter's lower case is two code points
                own = [(m.start() + a, m.end() + a) for m in _SENTENCE.finditer(t) if _WORD.search(m[0])]
                self.sentence_start[place == i], self.sentence_end[place == i] = np.array(own, np.int64).reshape(-1, 2).T
        self.features = hashed(self.text, points, self.start, self.end)

    def distinct(self, words: np.ndarray) -> np.ndarray:
        """Of these words the first of those that are equal within a sentence, in order."""
        ids: dict = {}
        same = np.array([ids.setdefault(self.text[a:b], len(ids)) for a, b in zip(self.start[words].tolist(), self.end[words].tolist())], np.int64)
        return words[np.sort(np.unique(self.of[words] * len(ids) + same, return_index=True)[1])]


def of_texts(texts: list):
    """The Pieces of texts; null is empty."""
    return (Piece(*p) for p in pieces(texts))

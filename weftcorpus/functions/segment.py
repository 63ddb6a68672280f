"""Words of texts without spaces: a dictionary, the lattice of its words in a text, and the best path through it.

The dictionary is a trie of characters whose words have costs. Every word of the
dictionary that a text has is an edge of its lattice, and so is every single
character, at a cost of its own; the segmentation is the path of least cost, found by
dynamic programming from left to right. Of paths of equal cost the one whose last
word is the longest counts, at every place.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftcorpus.functions import text as T


def costs(frequencies: dict[str, int], scale: int = 1000) -> dict[str, int]:
    """Whole-number costs of words from how often they occur: the negative logarithm of their share."""
    total = sum(frequencies.values())
    return {w: round(-scale * math.log(n / total)) for w, n in frequencies.items() if n > 0 and w}


class Trie:
    def __init__(self, words: dict[str, int], unknown: int):
        self.root: dict = {}
        self.unknown = unknown
        for word, cost in words.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = cost

    def words(self, text: str) -> list[str]:
        """The segmentation of a text."""
        n = len(text)
        best, back = [0] + [1 << 62] * n, [0] * (n + 1)
        for i in range(n):
            here, node = best[i], self.root
            if here + self.unknown < best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                cost = node.get("")
                # what starts earlier came first and stays at equal cost
                if cost is not None and (here + cost < best[j + 1] or here + cost == best[j + 1] and back[j + 1] == i):
                    best[j + 1], back[j + 1] = here + cost, i
        out, at = [], n
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]


@lru_cache(8)
def _trie(words: tuple, unknown: int) -> Trie:
    return Trie(dict(words), unknown)


def segmented(c: Column, words: dict[str, int], unknown: int = 20_000) -> Column:
    """The words of each text (an array) by a dictionary of words and their costs; a character that no word covers costs `unknown`."""
    key = tuple(sorted(words.items()))

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        trie = _trie(key, unknown)
        parts = [trie.words(x or "") for x in texts.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array([w for p in parts for w in p], pa.string()))

    return run(T.text(c))


def word_ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, as arrays."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))

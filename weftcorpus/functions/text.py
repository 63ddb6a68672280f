"""Text expressions: stripping, n-grams, ratios and matching with Unicode semantics.

A null text is an empty one everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftcorpus.functions import rules

_STRIPPED = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def rx(pattern: str) -> str:
    """A pattern with Unicode classes and '\\n' as the only line end."""
    return "(?Ud)" + pattern


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column) -> Column:
    """c without Unicode white space (and the separators U+001C to U+001F) at both ends."""
    return F.regexp_replace(c, _STRIPPED, "")


def stripped_length(c: Column) -> Column:
    return F.length(strip(c))


def found_all(c: Column, pattern: str) -> Column:
    """All matches of a pattern as an array."""
    return F.regexp_extract_all(c, F.lit(rx(pattern)), F.lit(0))


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    return reduce(Column.__or__, [c.rlike(rx(p)) for p in patterns], F.lit(False))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words], F.lit(False))


def char_ngrams(c: Column, n: int) -> Column:
    """All n-grams of code points. A look-ahead takes n and the pattern moves on by one."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def shingles(c: Column, n: int) -> Column:
    """Distinct n-grams of the stripped text; a shorter text is its own n-gram."""
    t = strip(c)
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(char_ngrams(t, n)))


def tokens(c: Column) -> Column:
    """Text as the diversity metrics see it: without spaces and line feeds, a token each character."""
    return F.translate(c, " \n", "")


def safe_ratio(x: Column, y: Column) -> Column:
    return x / F.greatest(y, F.lit(1))


def special_ratio(c: Column) -> Column:
    """The share of characters outside rules.ORDINARY."""
    return safe_ratio(F.length(F.regexp_replace(c, rx(f"[{rules.ORDINARY}]+"), "")), F.length(c))


def ngram_repetition(t: str, n: int) -> float:
    """The share of a text's n-grams that occur more than once in it."""
    x = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
    if len(x) < n:
        return 0.0
    grams, bits = len(x) - n + 1, int(x.max()).bit_length()
    if bits * n > 64:
        # few kinds of characters need fewer bits than their code points
        kinds, x = np.unique(x, return_inverse=True)
        bits = max(1, int(len(kinds) - 1).bit_length())
    if bits * n <= 64:
        kind = np.uint32 if bits * n <= 32 else np.uint64
        key = np.zeros(grams, kind)
        for i in range(n):
            key = (key << kind(bits)) | x[i : i + grams].astype(kind)
        key.sort()
        same = key[1:] == key[:-1]
    else:
        rows = np.stack([x[i : i + grams] for i in range(n)], axis=1)
        rows = rows[np.lexsort(rows.T)]
        same = (rows[1:] == rows[:-1]).all(axis=1)
    repeated = np.zeros(grams, bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    return float(repeated.sum()) / grams


def repetition_ratio(c: Column, n: int = 4) -> Column:
    """ngram_repetition() for Arrow batches. Measured on whole documents it is an
    order of magnitude faster than exploding or extracting n-grams in the JVM. Called
    nondeterministic, so that a filter on it doesn't run it a second time."""

    @pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ngram_repetition(t, n))

    return ratio.asNondeterministic()(c)


def repetition_ratio_native(c: Column, n: int = 4) -> Column:
    """The same with built-in functions only."""
    g = F.array_sort(char_ngrams(c, n))
    again = F.filter(g, lambda x, i: (F.get(g, i - 1) == x) | (F.get(g, i + 1) == x))
    return F.when(F.length(c) < n, F.lit(0.0)).otherwise(F.size(again) / F.size(g))

"""Slot spans: found by patterns, resolved left to right, tagged in the text.

All patterns look for their matches in a whole Arrow batch at once: its texts stand
one after another, apart by a character that no pattern matches, and each pattern
goes once over that text. Literals that every match of a pattern needs are looked up
by one automaton first, so that patterns without a chance cost nothing. Only matches
become rows of work; texts without any pass at the speed of the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T

_SPAN = "struct<st:int,neg:int,ord:int,type:string,value:string>"
_FOUND = "array<struct<st:int,en:int,type:string,value:string>>"
_APART = "\x00"
#: What may match the character between two texts, or look at it.
_OPEN = re.compile(r"(?<!\\)(?:\.|\^|\$|\(\?[=!<])|\[\^|\\[DSWbBAZP]|\\x00")


def _compiled(pattern: str):
    # \w is \p{L}, \p{N} and _ here
    return re.compile(pattern.replace(r"[\p{L}\p{N}_]", r"\w"))


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern, an enclosing group taken off."""
    while pattern.startswith("(?:") and _closing(pattern) == len(pattern) - 1:
        pattern = pattern[3:-1]
    out, depth, last, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 1)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[last:i])
            last = i + 1
        i += 1
    return [*out, pattern[last:]]


def _closing(pattern: str) -> int:
    depth, i = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 1)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1
    return -1


def needed(pattern: str) -> list[str] | None:
    """Literals of which every match of a pattern has one: the first plain stretch of each alternative, or of the
    alternatives of a group that isn't optional. None where an alternative has neither."""
    out = []
    for part in _alternatives(pattern):
        i, literal, found = 0, "", None
        while i < len(part) and found is None:
            c = part[i]
            if c == "(":
                end = i + _closing(part[i:])
                if part[end + 1 : end + 2] not in ("?", "*", "{") and part.startswith("(?:", i) and not literal:
                    found = needed(part[i : end + 1]) if part[i : end + 1] != pattern else None
                if found is None and literal:
                    found = [literal]
                i, c = end, ""
            elif c in "[\\.^$":
                if literal:
                    found = [literal]
                i = part.index("]", i + 1) if c == "[" else i + 1 if c == "\\" else i
                if part.startswith("\\p{", i - 1):
                    i = part.index("}", i)
            elif c in "?*{":
                # what stands before is optional
                literal = literal[:-1]
                if literal:
                    found = [literal]
                i = part.index("}", i) if c == "{" else i
            elif c == "+":
                pass
            else:
                literal += c
            i += 1
        if found is None and literal:
            found = [literal]
        if found is None:
            return None
        out += found
    return out


class Matcher:
    """The patterns of some slot types, ready to go over batches of texts."""

    def __init__(self, slots: dict[str, Sequence[str]]):
        self.kinds = list(slots)
        self.patterns = [(k, _compiled(p), _OPEN.search(p) is None) for k, kind in enumerate(slots) for p in slots[kind]]
        self.needs = [needed(p) for kind in slots for p in slots[kind]]
        literals = {x for need in self.needs if need for x in need}
        self.automaton = None
        if literals:
            try:
                import ahocorasick

                self.automaton = ahocorasick.Automaton()
                for x in literals:
                    self.automaton.add_word(x, x)
                self.automaton.make_automaton()
            except ImportError:
                self.automaton = re.compile("|".join(map(re.escape, sorted(literals, key=len, reverse=True))))

    def _possible(self, text: str) -> set[str]:
        """The literals that text has. Those that are part of others are there whenever these are, so one pass will do."""
        if self.automaton is None:
            return set()
        if isinstance(self.automaton, re.Pattern):
            found = set(self.automaton.findall(text))
            return found | {x for need in self.needs for x in need or () if any(x in y for y in found)}
        return {x for _, x in self.automaton.iter(text)}

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, end, number of the type): by start, then the longest, then in the patterns' order, none overlapping."""
        joined = _APART.join(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, np.int64)
        there = self._possible(joined)
        at, neg, order, kinds = [], [], [], []
        for n, ((kind, pattern, closed), need) in enumerate(zip(self.patterns, self.needs)):
            if need is not None and there.isdisjoint(need):
                continue
            if closed:
                own = [(m.start(), m.end()) for m in pattern.finditer(joined)]
            else:
                own = [(int(s) + m.start(), int(s) + m.end()) for s, t in zip(starts, texts) for m in pattern.finditer(t)]
            at += [a for a, _ in own]
            neg += [a - b for a, b in own]
            order += [n] * len(own)
            kinds += [kind] * len(own)
        at, neg, order, kinds = (np.array(x, np.int64) for x in (at, neg, order, kinds))
        row = np.searchsorted(starts, at, "right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        last = -1
        for i in np.lexsort((order, neg, at)).tolist():
            if at[i] >= last:
                r = int(row[i])
                begin = int(at[i] - starts[r])
                out[r].append((begin, begin - int(neg[i]), int(kinds[i])))
                last = at[i] - neg[i]
        return out


@lru_cache(16)
def _matcher(slots: tuple) -> Matcher:
    return Matcher({k: list(v) for k, v in slots})


def spans(t: Column, slots: dict[str, Sequence[str]] = rules.SLOTS) -> Column:
    """Non-overlapping spans (st, en, type, value): by start, then the longest, then in rule order."""
    key = tuple((k, tuple(v)) for k, v in slots.items())

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        matcher = _matcher(key)
        values = [x or "" for x in texts.to_pylist()]
        # a batch of texts is one string of a few MB at most
        each, run, size = [], [], 0
        for x in values:
            run.append(x)
            size += len(x)
            if size >= 1 << 20:
                each += matcher.spans(run)
                run, size = [], 0
        each += matcher.spans(run)
        flat = [(a, b, matcher.kinds[k], x[a:b]) for x, own in zip(values, each) for a, b, k in own]
        columns = list(zip(*flat)) or [()] * 4
        items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()))], ["st", "en", "type", "value"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), items)

    return found(T.text(t))


def _spans_of(t: Column, pattern: str, order: int, kind: str) -> Column:
    """All spans of one pattern as (start, -length, order, type, value)."""
    p = T.rx(pattern)
    # the text between matches and each match, side by side; the last gap has no match
    pairs = F.zip_with(F.split(t, p, -1), F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(a, x):
        start = (a["at"] + x["gap"]).cast("int")
        span = F.struct(start.alias("st"), (-F.length(x["value"])).cast("int").alias("neg"), F.lit(order).alias("ord"), F.lit(kind).alias("type"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), a).otherwise(F.struct((start + F.length(x["value"])).cast("int").alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(t.rlike(p), found).otherwise(empty)


def spans_native(t: Column, slots: dict[str, Sequence[str]] = rules.SLOTS) -> Column:
    """The same as spans() with built-in functions only; each pattern splits and extracts each text."""
    order, parts = 0, []
    for kind, patterns in slots.items():
        for p in patterns:
            parts.append(_spans_of(t, p, order, kind))
            order += 1
    every = F.array_sort(F.concat(*parts))
    empty = F.expr(f"cast(array() as {_FOUND})")
    fold = F.aggregate(
        every,
        F.struct(F.lit(0).alias("end"), empty.alias("out")),
        lambda a, x: F.when(
            x["st"] >= a["end"],
            F.struct((x["st"] - x["neg"]).alias("end"), F.concat(a["out"], F.array(F.struct(x["st"].alias("st"), (x["st"] - x["neg"]).alias("en"), x["type"].alias("type"), x["value"].alias("value")))).alias("out")),
        ).otherwise(a),
        lambda a: a["out"],
    )
    return fold


def tagged(t: Column, found: Column) -> Column:
    """The text with <slot type="T">V</slot> around each span."""
    done = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["en"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, x["st"] - a["at"]), F.lit('<slot type="'), x["type"], F.lit('">'), x["value"], F.lit("</slot>")).alias("out")),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return F.when(F.size(found) > 0, done).otherwise(t)


@dataclass(frozen=True)
class SlotAnnotator:
    slot_types: tuple[str, ...] | None = None
    text_fields: tuple[str, ...] = ("text", "response")
    keep_original: bool = True
    patterns: dict = field(default_factory=lambda: rules.SLOTS, hash=False)

    def annotate(self, df: DataFrame) -> DataFrame:
        """df with tagged text fields, {field}_original (null where the field is empty)
        and slots, a map of sorted distinct values for each type that was found."""
        slots = {k: v for k, v in self.patterns.items() if self.slot_types is None or k in self.slot_types}
        fields = [f for f in self.text_fields if f in df.columns]
        out = df.withColumns({f"_s_{f}": spans(T.text(f), slots) for f in fields})
        every = F.concat(*[F.col(f"_s_{f}") for f in fields]) if fields else F.expr("cast(array() as array<struct<st:int,en:int,type:string,value:string>>)")
        of_type = lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda s: s["type"] == k), lambda s: s["value"])))
        values = F.create_map(*[x for k in slots for x in (F.lit(k), of_type(k))])
        new = {"slots": F.map_filter(values, lambda _, v: F.size(v) > 0)}
        for f in fields:
            if self.keep_original:
                new[f"{f}_original"] = F.when(T.text(f) != "", F.col(f))
            new[f] = F.when(T.text(f) != "", tagged(F.col(f), F.col(f"_s_{f}"))).otherwise(F.col(f))
        return out.withColumns(new).drop(*[f"_s_{f}" for f in fields])

    def _types(self) -> list[str]:
        return [k for k in self.patterns if self.slot_types is None or k in self.slot_types]

    def _metrics(self) -> list[Column]:
        counts = [F.coalesce(F.sum(F.when(F.map_contains_key("slots", k), F.size(F.col("slots")[k])).otherwise(0)), F.lit(0)).alias(k) for k in self._types()]
        return [F.count("*").alias("total"), F.count_if(F.size("slots") > 0).alias("items_with_slots"), *counts]

    def observed(self, df: DataFrame, observation: Observation) -> DataFrame:
        """annotate() whose statistics the observation gets when the result is computed."""
        return self.annotate(df).observe(observation, *self._metrics())

    def summary(self, got: dict) -> dict:
        return {"total": got["total"], "items_with_slots": got["items_with_slots"], "slot_counts": {k: got[k] for k in self._types()}}

    def stats(self, annotated: DataFrame) -> DataFrame:
        """One row: total, items_with_slots and slot_counts (distinct values a row, summed)."""
        one = annotated.agg(*self._metrics())
        return one.select("total", "items_with_slots", F.create_map(*[x for k in self._types() for x in (F.lit(k), F.col(k))]).alias("slot_counts"))

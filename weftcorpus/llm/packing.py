"""Packing documents into sequences by cutting-stock column generation.

A document gives full pieces of `capacity` tokens, each a sequence of its own, and a
rest. Rests are counted by length, lengths are put into classes of `unit` tokens, and
the classes are the demand of a linear program: a pattern is a multiset of classes that
fill a sequence, and the program chooses how often to use each so that as few tokens as
possible are left over. Patterns are generated as they are needed: a knapsack dynamic
program over the capacity finds those of the best value at the current prices of classes.
The solution is rounded to whole numbers of sequences, and the rests, ranked by length,
are dealt to the slots of the patterns. What no pattern takes is laid end to end: it fills
what a pattern leaves open because rests are shorter than their class, and then sequences
of its own; the last stretch is cut at powers of two. So no sequence has padding, and only
documents that are longer than a sequence or that fill gaps are cut.

The driver sees a row for each length. Ranks are counted inside partitions and added up
over (partition, length), so neither a document nor a length is ever gathered, however
many documents share it. Sequence and offset follow from the histogram, length and rank
alone: tasks compute them without asking each other. Tokens are written once and read
again only for documents that are cut at an odd place.

Edge cases: null and empty texts have the end token only; rows that share an id or have
none are documents of their own; texts of any length are encoded whole; documents of equal
length are ranked in the order in which their partitions were read, so reruns give the same
sequences while the input's files are read in the same order, and the same number of them
always; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.llm.bpe import codec_of
from weftcorpus.llm.common import drop, table, text_bytes, trim, worker_cache, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Words:
    """Encodes texts by a tokenizer that drops white space and never joins what stands on both sides of it: the library
    encodes each distinct word once, in lower case and without the marks at its end where that changes nothing, and
    the texts' ids are put together from those of their words, all texts of a batch at once."""

    def __init__(self, spec: str, known: int = 500_000, longest: int = 64, together: int = 64):
        # tasks are what runs side by side
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self._batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.known, self.longest, self.together = known, longest, together
        a, b = self._alone(["a", "b"])
        for text in ("a b", "a\nb", "a\tb", "a\rb", " a  b "):
            if self._alone([text])[0] != a + b:
                raise ValueError("the tokenizer keeps white space")
        for mark in [*_MARKS, "&&", "',"]:
            if self._alone([f"A{mark}"])[0] != a + self._alone([mark])[0]:
                raise ValueError("the tokenizer keeps letter case, or marks with the words before them")
        bar = self._alone(["|"])[0]
        self.bar = bar[0] if len(bar) == 1 else None
        self._forget()

    def _forget(self):
        """Nothing is known but the empty word, which is 0."""
        self.have, self.whole, self.flat, self.size = {"": 0}, {"": 0}, np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._batch(texts, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has. Words go to the library many at a time, with a
        mark between them that none of them has."""
        ids, sizes = [], []
        for i in range(0, len(words), self.together):
            part = words[i : i + self.together]
            got = np.array(self._alone([" | ".join(part)])[0], np.uint32) if self.bar is not None and not any("|" in w for w in part) else None
            at = np.flatnonzero(got == self.bar) if got is not None else []
            if got is not None and len(at) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
                ids.append(np.delete(got, at))
            else:
                own = self._alone(part)
                sizes.append(np.array([len(x) for x in own], np.int64))
                ids.append(np.array([i for x in own for i in x], np.uint32))
        return np.concatenate(ids), np.concatenate(sizes)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Stores the ids of some words; their numbers."""
        n = len(sizes)
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.size : self.size + len(ids)] = ids
        self.lengths[self.count : self.count + n] = sizes
        self.starts[self.count : self.count + n] = self.size + np.cumsum(sizes) - sizes
        self.size, self.count = self.size + len(ids), self.count + n
        return range(self.count - n, self.count)

    def _learn(self, words: list[str]) -> None:
        """Words as they stand in texts: in lower case, and the marks at their end apart from what they follow."""
        parts = []
        for w in words:
            core, mark = w, ""
            if w[-1] in _MARKS:
                core = w.rstrip(_MARKS)
                if not core or core[-1] < "ɐ" and core[-1].isalnum() and "|" not in w:
                    mark = w[len(core) :]
                else:
                    core = w
            parts.append(core.lower() if core.isascii() and "|" not in core else core)
            parts.append(mark)
        new = set(parts).difference(self.have)
        if new:
            # words with a bar apart, so that they don't spoil a whole lot
            new = [w for w in new if "|" not in w] + [w for w in new if "|" in w]
            self.have.update(zip(new, self._keep(*self._ids(new))))
        place = np.array([self.have[w] for w in parts], np.int64)
        lengths = self.lengths[place]
        self.whole.update(zip(words, self._keep(gathered(self.flat, self.starts[place], lengths), lengths.reshape(-1, 2).sum(1))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each begins and the last ends."""
        for blank in "\t\n\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        kinds = split.flatten().dictionary_encode()
        words = kinds.dictionary.to_pylist()
        if len(self.have) > self.known or self.size > 32 * self.known:
            self._forget()
        elif 2 * len(self.whole) > self.known:
            self.whole = {"": 0}
        known = self.whole
        new = [w for w in words if w not in known]
        self._learn(new)
        place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[kinds.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[place]
        ids = gathered(self.flat, self.starts[place], lengths)
        offsets = split.offsets.to_numpy()
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets - offsets[0]]
        if max(map(len, new), default=0) > self.longest:
            self._forget()  # a word that long isn't worth its place
        return ids, at


def _lots(batches, most: int = 8 << 20):
    """Batches put together to lots of about `most` bytes: the larger a lot, the fewer words are distinct in it."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(column: pa.Array, most: int = 16 << 20):
    """(from, to) of runs of texts of about `most` bytes."""
    _, at = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j
        i = j


def id_type(path: str) -> str:
    """How ids are kept: two bytes each if the vocabulary is small enough."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, capacity: int, end: int, kept: str) -> DataFrame:
    """A written row for each document: part and row (its place), doc_id, n, the checksum of each piece of
    `capacity` tokens and of the rest, each piece's rank among those of its length in the partition, and the ids (of type kept)."""
    shared = codec_of(docs, path)

    def run(batches):
        spec = shared.value
        words = worker_cache(("words", hash(spec)), lambda: Words(spec))
        part, row, ranks = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        for batch in _lots(batches):
            texts = batch.column(1).fill_null("")
            for i, j in _runs(texts):
                ids, at = words.encode(texts.slice(i, j - i))
                n, sizes = j - i, np.diff(at) + 1
                sums, places, raw = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    cut = range(0, len(own), capacity)
                    sums.append([zlib.crc32(own[k : k + capacity].tobytes()) for k in cut])
                    lengths = [min(capacity, len(own) - k) for k in cut]
                    places.append([])
                    for length in lengths:
                        places[-1].append(int(ranks[length]))
                        ranks[length] += 1
                    raw.append(own.astype(kept).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column(0).slice(i, n), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array(raw, pa.binary())],
                    ["part", "row", "doc_id", "n", "sums", "ranks", "ids"],
                )
                row += n
        trim()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, row long, doc_id long, n long, sums array<long>, ranks array<long>, ids binary"), "tokens")


def priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of lengths that fill 0 to capacity exactly (-inf: none do), and the place of the length taken last. Unbounded knapsack."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    for w in range(1, capacity + 1):
        k = np.searchsorted(lengths, w, "right")
        if k:
            value = prices[:k] + best[w - lengths[:k]]
            j = int(value.argmax())
            best[w], last[w] = value[j], j
    return best, last


def _pattern(first: int, lengths: np.ndarray, last: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The pattern that takes length number `first` and fills the rest at best, as (place of a length, times)."""
    times, w = {first: 1}, capacity - lengths[first]
    while w:
        j = int(last[w])
        times[j] = times.get(j, 0) + 1
        w -= lengths[j]
    return tuple(sorted(times.items()))


def relaxed(lengths: np.ndarray, counts: np.ndarray, capacity: int, most_pivots: int = 4000, tolerance: float = 1e-7, columns: int = 64) -> dict[tuple, float]:
    """Patterns and how often each is used (fractions allowed) so that the tokens of lengths left over weigh least.

    Simplex over a growing set of columns: at first every length is left over, at a price of its tokens and a little
    more for long ones, which are harder to place later; a pattern costs nothing and enters while its lengths are
    worth something. Stops at the optimum or after most_pivots, with a feasible answer either way."""
    m = len(lengths)
    inverse, have = np.eye(m), counts.astype(np.float64)
    basis: list[tuple | None] = [None] * m
    prices = lengths * (1 + 0.1 * lengths / capacity)
    least, pivots = tolerance * capacity, 0
    while pivots < most_pivots:
        best, last = priced(lengths, prices, capacity)
        through = prices + best[capacity - lengths]
        tried = moved = 0
        seen = set()
        for first in np.argsort(-through, kind="stable"):
            if through[first] <= least or tried >= columns or pivots >= most_pivots:
                break
            pattern = _pattern(int(first), lengths, last, capacity)
            if pattern in seen:
                continue
            seen.add(pattern)
            tried += 1
            at, times = np.array(pattern).T
            gain = float(prices[at] @ times)
            if gain <= least:
                continue
            d = inverse[:, at] @ times
            up = np.flatnonzero(d > 1e-9)
            if not len(up):
                continue
            ratios = have[up] / d[up]
            step = ratios.min()
            # of equal ratios the largest pivot, for numbers that stay well-behaved
            near = up[ratios <= step + 1e-12]
            r = int(near[d[near].argmax()])
            row = inverse[r] / d[r]
            rows = np.flatnonzero(d)
            have = np.maximum(have - step * d, 0)
            have[r] = step
            inverse[rows] -= np.outer(d[rows], row)
            inverse[r] = row
            prices = prices - gain * row
            basis[r] = pattern
            moved += 1
            pivots += 1
        if not moved:
            break
    return {p: float(x) for p, x in zip(basis, have) if p is not None and x > 1e-9}


def plan_patterns(histogram: dict[int, int], capacity: int, rounds: int = 4) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) that fill capacity exactly, and how many sequences follow each; no length is used
    more often than the histogram has it. Fractions are rounded up as far as the lengths last, else down; what
    is left is solved again, a few times."""
    left = {length: n for length, n in histogram.items() if 0 < length <= capacity and n > 0}
    out: dict[tuple, int] = {}
    for _ in range(rounds):
        lengths = np.array(sorted(left), np.int64)
        if not len(lengths):
            break
        used = 0
        solved = relaxed(lengths, np.array([left[x] for x in lengths.tolist()]), capacity)
        for pattern, times in sorted(solved.items(), key=lambda x: (-x[1], x[0])):
            own = tuple((int(lengths[j]), n) for j, n in pattern)
            times = min(int(np.ceil(times - 1e-6)), *(left.get(x, 0) // n for x, n in own))
            if times > 0:
                for x, n in own:
                    left[x] -= times * n
                out[own] = out.get(own, 0) + times
                used += times
        left = {x: n for x, n in left.items() if n}
        if not used:
            break
    return sorted(out.items())


class Plan:
    """Where the piece of a length and rank goes. Its size depends on capacity and unit alone.

    Rests in order of length (then rank) have a number each. Slot t of pattern j takes the stretch of numbers
    from starts[j, t] on, one for each of the pattern's sequences, so how long the rests before it are, and how
    much each sequence leaves open, are differences of sums over stretches."""

    def __init__(self, histogram: dict[int, int], capacity: int, unit: int = 16):
        self.capacity, self.full = capacity, histogram.get(capacity, 0)
        counts = np.array([0, *(histogram.get(x, 0) for x in range(1, capacity))], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # the number of the first rest of each length
        self.tokens = np.concatenate([[0], np.cumsum(counts * np.arange(capacity))])  # and the tokens before it
        classes = -(-np.arange(capacity) // unit)
        demand = np.bincount(classes, counts).astype(np.int64)
        patterns = plan_patterns({c: int(n) for c, n in enumerate(demand)}, capacity // unit)
        first_of = self.first[[int(np.argmax(classes == c)) for c in range(len(demand))]]
        while True:
            self._lay(patterns, demand, first_of)
            lack = self.open - self.total
            if lack <= 0:
                break
            # too little is left over to fill what stays open: some sequences are given up, of patterns that leave most open
            patterns = list(patterns)
            for j in sorted(range(len(patterns)), key=lambda j: (self.gaps[j + 1] - self.gaps[j]) / -patterns[j][1]):
                fewer = min(patterns[j][1], -(-lack // capacity))
                patterns[j] = (patterns[j][0], patterns[j][1] - fewer)
                lack -= fewer * capacity
                if lack <= 0:
                    break
            patterns = [x for x in patterns if x[1]]

    def _lay(self, patterns, demand, first_of) -> None:
        """Slots, gaps and the leftover for these patterns."""
        taken, most = np.zeros_like(demand), max((sum(n for _, n in p) for p, _ in patterns), default=0)
        self.times = np.array([t for _, t in patterns], np.int64)
        self.slots = np.array([sum(n for _, n in p) for p, _ in patterns], np.int64)
        self.starts = np.zeros((len(patterns), most), np.int64)
        owner = []
        for j, (pattern, times) in enumerate(patterns):
            t = 0
            for c, n in pattern:
                for _ in range(n):
                    self.starts[j, t] = first_of[c] + taken[c]
                    owner.append((self.starts[j, t], j, t))
                    taken[c] += times
                    t += 1
        self.owner = np.array(sorted(owner), np.int64).reshape(-1, 3)
        self.ordinal = np.concatenate([[0], np.cumsum(self.times)])
        self.sequence = self.full + self.ordinal
        # what is left over: of each class the numbers from kept on; before: its tokens in earlier classes
        self.kept, self.class_at = first_of + taken, first_of
        left = self.before_number(first_of + demand) - self.before_number(self.kept)
        self.left_at, self.total = np.concatenate([[0], np.cumsum(left)]), int(left.sum())
        j = np.arange(len(patterns))
        self.gaps = np.concatenate([[0], np.cumsum(self._open(j, self.times))]).astype(np.int64)
        self.open = int(self.gaps[-1])
        self.whole, rest = divmod(max(self.total - self.open, 0), self.capacity)
        ends, at = [], self.whole * self.capacity
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.tail = np.array([self.whole * self.capacity, *ends], np.int64)
        self.sequences = int(self.sequence[-1]) + self.whole + len(ends)

    def length_of(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, number, "right") - 1

    def before_number(self, number: np.ndarray) -> np.ndarray:
        """Tokens of the rests with smaller numbers."""
        length = np.minimum(self.length_of(number), self.capacity)
        return self.tokens[length] + (number - self.first[length]) * length

    def _open(self, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """What the first k sequences of pattern j leave open."""
        out = k * self.capacity
        for t in range(int(self.slots[j].max(initial=0))):
            i = np.flatnonzero(t < self.slots[j])
            start = self.starts[j[i], t]
            out[i] -= self.before_number(start + k[i]) - self.before_number(start)
        return out

    def _ahead(self, j: np.ndarray, k: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The tokens of sequence k of pattern j before a slot."""
        out = np.zeros(len(j), np.int64)
        for t in range(int(slot.max(initial=0))):
            i = np.flatnonzero(t < slot)
            out[i] += self.length_of(self.starts[j[i], t] + k[i])
        return out

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, skip, size, sequence, offset): piece i of the arguments, from its token number `skip` on, goes there."""
        index, full = np.arange(len(length)), length == self.capacity
        parts = [(index[full], 0 * rank[full], length[full], rank[full], 0 * rank[full])]
        index = index[~full]
        number = self.first[length[index]] + rank[index]
        kind = np.searchsorted(self.class_at, number, "right") - 1
        slotted = number < self.kept[kind]
        i, n = index[slotted], number[slotted]
        if len(i):
            start, j, t = self.owner[np.searchsorted(self.owner[:, 0], n, "right") - 1].T
            parts.append((i, 0 * i, length[i], self.sequence[j] + n - start, self._ahead(j, n - start, t)))
        i, n, kind = index[~slotted], number[~slotted], kind[~slotted]
        begin = self.left_at[kind] + self.before_number(n) - self.before_number(self.kept[kind])
        end = begin + length[i]
        # the sequences whose gaps a leftover rest fills, from the first to the last
        gap = np.flatnonzero(begin < self.open)
        if len(gap):
            first, last = self._filled(begin[gap]), self._filled(np.minimum(end[gap], self.open) - 1)
            who, own = np.repeat(gap, last - first + 1), gathered(np.arange(int(last.max()) + 1), first, last - first + 1)
            j = np.searchsorted(self.ordinal, own, "right") - 1
            k = own - self.ordinal[j]
            low, high = self.gaps[j] + self._open(j, k), self.gaps[j] + self._open(j, k + 1)
            start, stop = np.maximum(low, begin[who]), np.minimum(high, end[who])
            some = stop > start
            who, j, k, low, start, stop = (x[some] for x in (who, j, k, low, start, stop))
            parts.append((i[who], start - begin[who], stop - start, self.sequence[j] + k, self._ahead(j, k, self.slots[j]) + start - low))
        # and those of sequences made of leftovers alone
        late = end > self.open
        i, begin, end = i[late], begin[late] - self.open, end[late] - self.open
        at = np.maximum(begin, 0)
        while len(i):
            whole = at < self.whole * self.capacity
            place = np.searchsorted(self.tail, at, "right")
            low = np.where(whole, at // self.capacity * self.capacity, self.tail[np.maximum(place - 1, 0)])
            high = np.where(whole, low + self.capacity, self.tail[np.minimum(place, len(self.tail) - 1)])
            sequence = self.sequence[-1] + np.where(whole, at // self.capacity, self.whole + place - 1)
            stop = np.minimum(end, high)
            parts.append((i, at - begin, stop - at, sequence, at - low))
            more = stop < end
            i, begin, at, end = i[more], begin[more], stop[more], end[more]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _filled(self, at: np.ndarray) -> np.ndarray:
        """The number among the patterns' sequences of the one whose gap has leftover token `at`."""
        j = np.searchsorted(self.gaps, at, "right") - 1
        a, b = np.zeros(len(j), np.int64), self.times[j] - 1
        while (a < b).any():
            middle = (a + b + 1) // 2
            ok = self.gaps[j] + self._open(j, middle) <= at
            a, b = np.where(ok, middle, a), np.where(ok, b, middle - 1)
        return self.ordinal[j] + a


def packed(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, unit: int = 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    kept = id_type(path)
    tokens = tokenized(docs, path, capacity, end, kept)
    pieces = tokens.select("part", "row", "doc_id", "n", F.posexplode(F.arrays_zip("sums", "ranks")).alias("k", "p"))
    pieces = pieces.select("part", "row", "doc_id", "n", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.col("p.sums").alias("crc"), F.col("p.ranks").alias("rank")).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")))
    counts = written(pieces.groupBy("part", "length").count(), "piece-counts")
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity, unit)  # `capacity` rows at most
    shared = spark.sparkContext.broadcast(plan)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # a row for each length in each partition: broadcast only while they are few
    bases = F.broadcast(bases) if counts.count() <= 500_000 else bases
    ranked = pieces.join(bases, ["part", "length"]).select("part", "row", "doc_id", "n", "start", "length", "crc", (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches):
        for batch in batches:
            part, row, doc, n, start, length, crc, rank = batch.columns
            sizes = length.to_numpy()
            i, skip, size, sequence, offset = shared.value.place(sizes, rank.to_numpy())
            at = pa.array(i)
            known = pa.array(crc.to_numpy()[i], mask=size < sizes[i])
            yield pa.RecordBatch.from_arrays([part.take(at), row.take(at), doc.take(at), pa.array(start.to_numpy()[i] + skip), pa.array(size), known, n.take(at), pa.array(sequence), pa.array(offset)], ["part", "row", *(c.split()[0] for c in PIECES.split(", "))])

    placed = written(ranked.mapInArrow(run, f"part int, row long, {PIECES}"), "placed")
    names = [c.split()[0] for c in PIECES.split(", ")]
    # pieces of documents that were cut at an odd place need the checksum of their own ids
    cut = placed.where("ids_crc32 IS NULL").groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))

    def sums(batches):
        for batch in batches:
            rows = []
            for doc, n, ids, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, kept).astype("<u4")
                rows += [(doc, c["start"], c["length"], zlib.crc32(ids[c["start"] : c["start"] + c["length"]].tobytes()), n, c["sequence_id"], c["offset"]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 7)], names)

    cut = written(cut, "cuts")
    weight = cut.agg(F.coalesce(F.sum(F.size("cuts") * 32 + 50), F.lit(0))).first()[0]
    # beside few cut documents the ids of the others needn't move
    mended = written(tokens.join(F.broadcast(cut) if weight <= 32 << 20 else cut, ["part", "row"]).select("doc_id", "n", "ids", "cuts").mapInArrow(sums, PIECES), "cut-pieces")
    drop(tokens, counts, cut)
    return placed.where("ids_crc32 IS NOT NULL").select(names).unionByName(mended)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

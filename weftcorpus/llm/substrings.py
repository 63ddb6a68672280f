"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier.

1. Anchors. In each string of that length, the k-gram with the least hash is its
   anchor; equal strings choose alike. Starts that share an anchor are a range,
   and the bytes of all their strings its context.
2. Contexts meet by anchor. Of equal contexts the earliest stays and the others
   are repeats as a whole; a task merges its own before anything moves. An anchor
   with one context alone is done.
3. Where an anchor has unlike contexts, one of each kind is fetched, and blocks of
   them are indexed: suffix array, Burrows-Wheeler transform, and breadth-first
   backward extension of intervals, which finds the common prefixes of neighbouring
   suffixes by increasing value and stops at `length`; what is open then is equal.
   An anchor with more contexts than a block may hold compares digests of its
   strings in a sorted stream instead, so no group has to fit into one task.

Order is (doc_id, start). Rows with a null doc_id come last, each unlike text among
them a document of its own, in the order of its hash; so are unlike texts that share
a doc_id. Rows that agree in id and text are one document and never repeats of each
other. Texts beyond `piece` bytes go through in overlapping pieces of that size, with the
same result. Null texts are empty; texts shorter than `length` lose nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import as_long, bloom_of, drop, freed, mix64, shared_dir, table, text_bytes, trim, worker_cache, written
from weftcorpus.llm.shingles import text_blocks

LENGTH, GRAM = 100, 32
#: Bits of a byte's place in what is hashed at a time; longer texts go in pieces that overlap.
_PLACE_BITS = 28
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
ANCHORS = "kind int, h long, t long, doc long, s int, e int, p int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""

    def make(size):
        inverse = pow(_BASE, -1, 1 << 64)
        return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (_BASE, inverse))

    size = 1 << max(20, int(n).bit_length())
    return worker_cache(("powers", size), lambda: make(size))


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Of a block of texts: (h, t, text number, s, e, p) of each anchor, places relative to the text's start."""
    n, none = len(data), [np.zeros(0, np.int64)] * 6
    if n < length:
        return none
    forward, back = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * forward[:n], dtype=np.uint64)])
    h = mix64((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    key = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - gram + 1, 1
    low = key
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(h) - width + 1], low[width - step : width - step + len(h) - width + 1])
    place = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)  # of start i
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.arange(len(place))
    whole = start + length <= at[text[: len(place)] + 1]
    start = start[whole]
    if not len(start):
        return none
    place, text = place[start], text[start]
    first = np.ones(len(start), bool)
    first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(first)
    j = np.append(i[1:], len(start)) - 1
    s, e, p, d = start[i], start[j], place[i], text[i]
    t = mix64((sums[e + length] - sums[s]) * back[s] + mix64(((p - s) * 256 + (e - s)).astype(np.uint64)))
    base = at[d]
    return h[p].view(np.int64), t.view(np.int64), d, s - base, e - base, p - base


def _pieces(data: np.ndarray, at: np.ndarray, length: int, most: int = 1 << (_PLACE_BITS - 1)):
    """(place of its first byte, bytes, offsets) of a block, or of the pieces of its one long text. Each string of `length` is in one piece."""
    if len(data) <= most:
        yield 0, data, at
    else:
        for i in range(0, len(data), most):
            part = data[i : i + most + length - 1]
            yield i, part, np.array([0, len(part)])


def _rows(kind, h, t, doc, s, e, p):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), *[pa.array(x, pa.int64()) for x in (h, t, doc)], *[pa.array(x, pa.int32()) for x in (s, e, p)]], ["kind", "h", "t", "doc", "s", "e", "p"])


def merged_ranges(doc, s, e):
    """Ranges of starts with neighbours of the same text joined, sorted."""
    order = np.lexsort((e, s, doc))
    doc, s, e = doc[order], s[order], e[order]
    if not len(doc):
        return doc, s, e
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(new) - 1
    # one running maximum for all texts: ends are lifted by the text's number
    lift = group * (int(e.max()) + int(s.max()) + 4)
    reach = np.maximum.accumulate(e + lift)
    start = new.copy()
    start[1:] |= s[1:] + lift[1:] > reach[:-1] + 1
    i = np.flatnonzero(start)
    return doc[i], s[i], np.append(reach[i[1:] - 1], reach[-1]) - lift[i]


def anchor_rows(docs: DataFrame, length: int, gram: int, chunk: int = 200_000, piece: int = 1 << (_PLACE_BITS - 1)) -> DataFrame:
    """Kind 0: contexts, of equal ones of a chunk the earliest. Kind 1: ranges of starts that are repeats."""

    def thin(parts):
        h, t, doc, s, e, p = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((s, doc, t, h))
        h, t, doc, s, e, p = (x[order] for x in (h, t, doc, s, e, p))
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        again = (doc != doc[lead]) | (s != s[lead])
        yield from _cut(_rows(0, *(x[first] for x in (h, t, doc, s, e, p))))
        if again.any():
            d, a, b = merged_ranges(doc[again], s[again], e[again])
            yield from _cut(_rows(1, mix64(d.view(np.uint64)).view(np.int64), d * 0, d, a, b, a * 0))

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            ids = as_long(batch.column(0))
            data, at = text_bytes(batch.column(1))
            for a, b, whole, ends in text_blocks(data, at, min(1 << 20, piece)):
                for first, own, off in _pieces(whole, ends, length, piece):
                    h, t, d, s, e, p = anchors(own, off, length, gram)
                    if len(h):
                        parts.append((h, t, ids[a:b][d], s + first, e + first, p + first))
                        size += len(h)
                if size >= chunk:
                    yield from thin(parts)
                    parts, size = [], 0
        if parts:
            yield from thin(parts)
        trim()

    return docs.mapInArrow(run, ANCHORS)


def _cut(batch, rows: int = 50_000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def compared(rows: DataFrame) -> DataFrame:
    """From anchor_rows(): kind 1 as before and for contexts that repeat an earlier
    one; kind 2 for the contexts that have to be compared byte by byte."""

    def run(batches):
        open_ = None  # (h, contexts so far, the only one of them, t, doc, s of the last one's first)
        for batch in batches:
            done = as_long(batch.column(0)) == 1
            if done.any():
                yield batch.filter(pa.array(done))
            if done.all():
                continue
            h, t, doc, s, e, p = (as_long(batch.filter(pa.array(~done)).column(i)) for i in range(1, 7))
            n = len(h)
            new_h, new_t = np.ones(n, bool), np.ones(n, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_t[1:] = new_h[1:] | (t[1:] != t[:-1])
            goes_on = open_ is not None and open_[0] == h[0]
            new_t[0] = not (goes_on and open_[3] == t[0])
            lead = np.maximum.accumulate(np.where(new_t, np.arange(n), -1))
            lead_doc, lead_s = np.where(lead >= 0, doc[lead], open_[4] if goes_on else 0), np.where(lead >= 0, s[lead], open_[5] if goes_on else 0)
            again = ~new_t & ((doc != lead_doc) | (s != lead_s))
            if again.any():
                yield _rows(1, h[again], t[again], doc[again], s[again], e[again], p[again])
            run_at = np.flatnonzero(new_h)
            run_of = np.cumsum(new_h) - 1
            contexts = np.add.reduceat(new_t.astype(np.int64), run_at)
            if goes_on:
                contexts[0] += open_[1]
            ask = new_t & (contexts[run_of] >= 2)
            if ask.any():
                yield _rows(2, h[ask], t[ask], doc[ask], s[ask], e[ask], p[ask])
            if goes_on and open_[1] == 1 and contexts[0] >= 2:
                yield _rows(2, *(np.array([x]) for x in open_[2]))
            last_lead = lead[-1]
            if last_lead >= 0:
                only = tuple(int(x[last_lead]) for x in (h, t, doc, s, e, p))
                open_ = (int(h[-1]), int(contexts[-1]), only, int(t[-1]), only[2], only[3])
            else:
                open_ = (open_[0], int(contexts[-1]), *open_[2:])

    return rows.repartition("h").sortWithinPartitions("kind", "h", "t", "doc", "s").mapInArrow(run, ANCHORS)


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the rotations of text sorted by their first bytes, and the
    number of each one's class of equal first `length` bytes."""
    n = len(text)
    wrap = np.resize(text, n + 8)
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | wrap[i : i + n]
    size = 8
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_ = rank[order]
        dense = np.zeros(n, np.uint64)
        dense[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]).astype(np.uint64)
        if size >= length:
            break
        rank = (dense << np.uint64(32)) | np.roll(dense, -size)
        size *= 2
    bwt = text[(order - 1) % n]
    step = np.empty(n, np.int64)  # of a rotation to the one that starts a byte before it
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    border = np.zeros(n + 1, bool)
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        # every interval is extended to the left by each byte that stands there
        one = high - low == 1
        lows, highs = [step[low[one]]], [step[low[one]] + 1]
        low, high = low[~one], high[~one]
        if len(low):
            size = high - low
            base = np.repeat(np.cumsum(size) - size, size)
            at = np.arange(size.sum()) - base + np.repeat(low, size)
            key = np.repeat(np.arange(len(low)), size) * 256 + bwt[at]
            by = np.argsort(key, kind="stable")
            key, to = key[by], step[at[by]]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lows.append(to[new])
            highs.append(to[np.append(new[1:], len(to)) - 1] + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        # an end that is open gets this common prefix; the others were found shorter
        fresh = ~border[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        border[high] = True
    border[0] = False
    return order, np.cumsum(border[:n])


def repeats_in(contexts: list[tuple], length: int):
    """(doc, s, e) of the starts whose string an earlier start of the block has. contexts: (doc, s, bytes)."""
    text = np.frombuffer(b"\0" + b"\0".join(c[2] for c in contexts) + b"\0", np.uint8)
    sizes = np.array([len(c[2]) for c in contexts])
    begin = np.concatenate([[1], 1 + np.cumsum(sizes + 1)[:-1]])
    starts = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(contexts)), starts)
    offset = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    order, group = equal_prefixes(text, length)
    of = np.empty(len(text), np.int64)
    of[order] = group
    g = of[begin[which] + offset]
    doc = np.array([c[0] for c in contexts])[which]
    s = np.array([c[1] for c in contexts])[which] + offset
    return first_stays(g, doc, s)


def first_stays(g, doc, s):
    order = np.lexsort((s, doc, g))
    g, doc, s = g[order], doc[order], s[order]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    again = (doc != doc[lead]) | (s != s[lead])
    return merged_ranges(doc[again], s[again], s[again])


def contexts_of(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(h, doc, s, text) of kind 2 rows; of the texts, only those of asked documents move."""
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("h", "s", "e")).alias("asks"))
    texts = _only(docs, bloom_of(asked.select("doc").distinct(), "doc"), True)

    def run(batches):
        for batch in batches:
            h, doc, s, out = [], [], [], []
            for d, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for a in asks:
                    if a["e"] + length <= len(text):
                        h.append(a["h"])
                        doc.append(d)
                        s.append(a["s"])
                        out.append(text[a["s"] : a["e"] + length])
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.int32()), pa.array(out, pa.binary())], ["h", "doc", "s", "text"])
                    h, doc, s, out = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.int32()), pa.array(out, pa.binary())], ["h", "doc", "s", "text"])

    return texts.join(lists, "doc").select("doc", "text", "asks").mapInArrow(run, "h long, doc long, s int, text binary")


def _only(docs: DataFrame, bloom, there: bool) -> DataFrame:
    """doc and text of the rows that the filter may have (or surely hasn't)."""
    may = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        for batch in batches:
            has = may.value.may_have(as_long(batch.column(0)))
            part = batch.filter(pa.array(has if there else ~has))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.binary())], ["doc", "text"])

    return docs.mapInArrow(run, "doc long, text binary")


def indexed_repeats(contexts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Ranges of repeated starts among contexts that meet by anchor, a block of whole anchors at a time."""

    def run(batches):
        held, group, size, name = [], [], 0, None

        def found(contexts):
            doc, s, e = repeats_in(contexts, length)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["doc", "s", "e"])

        for batch in batches:
            for h, doc, s, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != name:
                    held += group
                    if size > block_bytes:
                        yield found(held)
                        held, size = [], 0
                    group, name = [], h
                group.append((doc, s, text))
                size += len(text) + 1
        held += group
        if held:
            yield found(held)
        trim()

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, s int, e int")


def digested_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: a row for each start, dealt by the digest of its string."""

    def explode(batches):
        for batch in batches:
            for h, doc, s, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(text) - length + 1
                dig = [xxhash.xxh3_128_digest(text[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(dig, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array(range(s, s + n), pa.int32())], ["g", "doc", "s"])

    def run(batches):
        lead = None
        for batch in batches:
            doc, s = [], []
            for g, d, a in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if lead is None or lead[0] != g:
                    lead = (g, d, a)
                elif (d, a) != lead[1:]:
                    doc.append(d)
                    s.append(a)
            d, a, b = merged_ranges(np.array(doc, np.int64), np.array(s, np.int64), np.array(s, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc", "s", "e"])

    return contexts.mapInArrow(explode, "g binary, doc long, s int").repartition("g").sortWithinPartitions("g", "doc", "s").mapInArrow(run, "doc long, s int, e int")


def _digests(texts, ranges, length):
    """n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each text."""
    out = []
    for text, own in zip(texts, ranges):
        n, spans, removed, kept = len(text), 0, 0, hashlib.sha256()
        left, at = [], 0
        for s, e in sorted(own):
            end = min(e + length, n)
            if end <= at and spans:
                continue
            if not spans or s > at:
                left.append(text[at:s])
                spans += 1
                removed += end - s
            else:
                removed += end - at
            at = end
        left.append(text[at:])
        for part in left:
            kept.update(part)
        out.append((n, removed, spans, kept.hexdigest(), b"".join(left)))
    return out


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a number for each pair of id and text instead of the id, in the order of ids, nulls
    last; and the table of (key, id), or nothing where every id stands for one text and is its own number.

    Pairs, as ids and two hashes of the text, are sorted by ranges and counted; texts get their number by a join."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.withColumn("tie", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    texts = ids.groupBy("doc_id").agg(F.min("tie").alias("low"), F.max("tie").alias("high"))
    if texts.where("doc_id IS NULL OR low <> high").isEmpty():
        return rows, None
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    sorted_ = written(ids.select("doc_id", "tie").distinct().repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "tie", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")), "pairs")
    before, shifts = 0, []
    for r in sorted_.groupBy("part").agg(F.count("*").alias("n"), F.min("i").alias("first")).orderBy("part").collect():  # a row for each partition
        shifts.append((r.part, before - r.first))
        before += r.n
    shift = docs.sparkSession.createDataFrame(shifts, "part int, shift long")
    numbers = written(sorted_.join(F.broadcast(shift), "part").select((F.col("i") + F.col("shift")).alias("key"), F.col("doc_id").alias("id"), F.col("tie").alias("same")), "numbers")
    own = ids.join(numbers, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("same")))
    return written(own.select(F.col("key").alias("doc_id"), "text"), "keyed"), numbers.select("key", "id")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = 1 << 19, most_contexts: int = 20_000, piece: int = 1 << (_PLACE_BITS - 1)) -> DataFrame:
    """(doc, s, e): ranges of starts whose string also starts earlier. docs: doc_id (not null), text."""
    found = written(compared(anchor_rows(docs, length, gram, piece=piece)), "anchors")
    freed(docs.sparkSession)
    asked = found.where("kind = 2").select("h", "doc", "s", "e")
    many = written(asked.groupBy("h").count().where(F.col("count") > most_contexts).select("h"), "frequent")
    n_many = many.count()
    contexts = contexts_of(asked, docs, length)
    parts = found.where("kind = 1").select("doc", "s", "e")
    if n_many:
        contexts = written(contexts, "contexts")
        side = F.broadcast(many) if n_many <= 100_000 else many
        parts = parts.unionByName(digested_repeats(contexts.join(side, "h", "left_semi"), length))
        contexts = contexts.join(side, "h", "left_anti")
    out = written(parts.unionByName(indexed_repeats(contexts, length, block_bytes)), "ranges")
    drop(found, *([contexts] if hasattr(contexts, "_weft_path") else []))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = 1 << 19, most_contexts: int = 20_000, piece: int = 1 << (_PLACE_BITS - 1)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    shared_dir(docs.sparkSession)
    docs, ids = keyed(docs)
    ranges = repeated_ranges(docs, length, gram, block_bytes, most_contexts, piece)
    lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("own"))
    bloom = bloom_of(ranges.select("doc").distinct(), "doc")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            own = [[(r["s"], r["e"]) for r in x or ()] for x in batch.column(2).to_pylist()] if batch.num_columns > 2 else [()] * len(texts)
            cols = list(zip(*_digests(texts, own, length))) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = _only(docs, bloom, False).mapInArrow(run, schema)
    cut = _only(docs, bloom, True).join(lists, "doc", "left").select("doc", "text", "own").mapInArrow(run, schema)
    out = whole.unionByName(cut)
    return out if ids is None else out.join(ids, out["doc_id"] == ids["key"]).withColumn("doc_id", F.col("id")).drop("key", "id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")

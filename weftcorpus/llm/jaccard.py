"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

1. Rows with the same shingle set become one vertex.
2. A set's index keys are the first n - ceil(t n) + 1 of its shingles in a global
   order, rare ones first (counts of hashed cells over all rows, then the hash):
   two sets that reach the threshold t share a key, whatever the order.
3. Rows of a key are first linked in stars, and the stars' components joined, so
   that a group of near copies costs as many comparisons as it has members.
4. What is left, rows of one key in different components, goes to tiles by key and
   size band; a key with more rows than a tile may hold is cut into several tiles.
   In a tile, the bits in which two parity signatures differ bound the overlap
   from above. Components with rows that pass are joined to families; a tile says so
   by the edges of a forest, fewer than it has rows, not by its pairs.
5. Each family's texts meet in one place, or in places by two cuts where they are many.
   Its rows of different components are compared exactly there, as bitmaps over the
   shingles that they share; again a forest of the links leaves the task.

Since links within a component add nothing to it, the components are exact.
Edge cases: texts without words (null ones too) link with nothing; rows that
repeat a doc_id are one document; a null doc_id gets a null component; very long texts
are shingled whole; an empty table gives an empty result; other columns are not read, or
pass through without_near_copies().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import as_long, bloom_of, drop, freed, mix64, shared_dir, table, text_bytes, trim, written
from weftcorpus.llm.components import components
from weftcorpus.llm.shingles import shingle_sets, text_blocks

WIDTH = 5
SIGNATURE_BITS = 256


def needed(n, percent: int):
    """The least overlap of a set of n with any partner that reaches the threshold."""
    return (percent * n + 99) // 100


def signature(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of three quarters as many cells as the set has members
    or more (a power of two, SIGNATURE_BITS at least): every differing bit takes a differing
    shingle, and unlike sets differ in about half of the bits, which is beyond the threshold."""
    bits = max(SIGNATURE_BITS, 1 << int(len(s) * 3 // 4).bit_length())
    cell = (mix64(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, the wider ones folded to the width of the
    narrowest: a cell modulo half the width has the parity of its two cells."""
    width = min(map(len, signatures)) // 8
    out = np.empty((len(signatures), width), np.uint64)
    for i, raw in enumerate(signatures):
        x = np.frombuffer(raw, np.uint64)
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _sets(batch, width):
    data, at = text_bytes(batch.column(1))
    for a, b, own, off in text_blocks(data, at):
        yield batch.column(0).slice(a, b - a), shingle_sets(own, off, width)


def cell_classes(docs: DataFrame, bits: int, width: int) -> np.ndarray:
    """For each of 2^bits cells of shingles, by how many half doublings its count is well above the mean."""
    slices = max(1, 1 << (bits - 16))  # a task adds up one or a few of them, whatever their number of senders
    size = (1 << bits) // slices

    def counted(batches):
        n = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for _, sets in _sets(batch, width):
                cell, k = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                n[cell] = np.minimum(n[cell] + k, 65535)
        for i in range(slices):
            part = n[i * size : (i + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "n"])
        del n, part
        trim()

    def added(batches):
        have = {}
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(n), np.uint16).astype(np.int64)
                if i in have:
                    have[i] += own
                else:
                    have[i] = own
        for i, n in have.items():
            # in half doublings above 1, so that a slice is a byte a cell
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([np.round(2 * np.log2(np.maximum(n, 1))).astype(np.uint8).tobytes()], pa.binary())], ["slice", "total", "n"])

    logs, total = np.zeros(1 << bits, np.uint8), 0
    for row in docs.mapInArrow(counted, "slice int, n binary").repartition("slice").mapInArrow(added, "slice int, total long, n binary").collect():
        logs[row.slice * size : (row.slice + 1) * size] = np.frombuffer(row.n, np.uint8)
        total += row.total
    mean = 2 * np.log2(max(total / (1 << bits), 1.0)) + 1
    return np.where(logs > mean, logs - np.uint8(mean), 0).astype(np.uint8)


def indexed(docs: DataFrame, classes, bits: int, width: int, percent: int) -> DataFrame:
    """doc_id, n, digest, signature and index keys of every row."""

    def run(batches):
        order = classes.value
        for batch in batches:
            for ids, sets in _sets(batch, width):
                keys, dig, sig = [], [], []
                for s in sets:
                    n = len(s)
                    dig.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                    sig.append(signature(s) if n else None)
                    rare = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    keys.append(s[np.argsort(rare, kind="stable")[: n - needed(n, percent) + 1]] if n else s)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = pa.array(np.concatenate(keys).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "n", "digest", "sig", "keys"]
                )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sig binary, keys array<long>")


def shared_keys(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (key, v, n) that share their key with a vertex whose size allows the threshold,
    each with a leader: the smallest vertex of its key in reach, so that leaders follow the sizes."""

    def run(batches):
        # in the order of sizes a row has a partner in reach if a row beside it is in reach
        fits = lambda k, n, i, j: (k[i] == k[j]) & (n[i] * 100 >= percent * n[j])
        held, partner, lead = None, False, None
        for batch in batches:
            k, v, n = (as_long(batch.column(i)) for i in range(3))
            if not len(k):
                continue
            if held is not None:
                k, v, n = (np.concatenate([[a], b]) for a, b in zip(held, (k, v, n)))
            near = fits(k, n, slice(None, -1), slice(1, None))
            keep = np.concatenate([[partner], near])
            keep[:-1] |= near
            held, partner = (k[-1], v[-1], n[-1]), bool(keep[-1])
            at = np.flatnonzero(keep[:-1])
            if len(at):
                out, lead = _led(k[at], v[at], n[at], lead, percent)
                yield out
        if held is not None and partner:
            yield _led(*(np.array([x]) for x in held), lead, percent)[0]

    return postings.repartition("key").sortWithinPartitions("key", "n", "v").mapInArrow(run, "key long, v long, n long, leader long")


def _led(k, v, n, lead, percent):
    """Rows in the order of (key, n, v) with their leaders, and the last leader (key, v, n)."""
    out = []
    for key, x, m in zip(k.tolist(), v.tolist(), n.tolist()):
        if lead is None or lead[0] != key or lead[2] * 100 < percent * m:
            lead = (key, x, m)
        out.append(lead[1])
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.int64())], ["key", "v", "n", "leader"]), lead


def bounded(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the threshold."""
    side = lambda x: vertices.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = as_long(batch.column("na")), as_long(batch.column("nb"))
            apart = np.empty(len(na), np.int64)
            for i, pair in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
                x, y = folded(list(pair))
                apart[i] = int(np.bitwise_count(x ^ y).sum())
            ok = _allowed(na, nb, apart, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _allowed(na, nb, apart, percent):
    """overlap <= (na + nb - apart) / 2 must allow 100 overlap >= percent (na + nb - overlap)."""
    overlap = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
    return 100 * overlap >= percent * (na + nb - overlap)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold exactly. Only the sets of rows that pairs name are moved, and of those few others."""
    pairs = written(pairs, "pairs")
    freed(docs.sparkSession)
    named = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    may = docs.sparkSession.sparkContext.broadcast(bloom_of(named, "v"))

    def run(batches):
        for batch in batches:
            ids = as_long(batch.column(0))
            batch = batch.filter(pa.array(may.value.may_have(ids)))
            for own, sets in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([own, pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "s"])

    sets = docs.where("doc_id IS NOT NULL").mapInArrow(run, "v long, s binary")
    # sets are shuffled, never broadcast: so no task has a Python worker for sets and one for pairs
    side = lambda x: sets.select(F.col("v").alias(x), F.col("s").alias(f"s{x}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def exact(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long")


class Forest:
    """Disjoint sets of whole numbers."""

    def __init__(self):
        self.up = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def of(self, x: np.ndarray) -> np.ndarray:
        some, at = np.unique(x, return_inverse=True)
        return np.array([self.find(y) for y in some.tolist()], np.int64)[at]

    def new(self, a: np.ndarray, b: np.ndarray):
        """The edges (a, b) that join what was apart, as a batch."""
        some = np.unique(np.stack([a, b]), axis=1).T.tolist()
        some = [x for x in some if self.join(*x)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.int64()) for i in (0, 1)], ["a", "b"])


def tiles(postings: DataFrame, vertices: DataFrame, labels: DataFrame, percent: int, tile_rows: int = 8192, spanning: bool = False) -> DataFrame:
    """Pairs of different components that share a key and that size and signature allow; with
    spanning, edges between the components' roots that join the same ones as these pairs do."""
    rows = postings.select("key", "v", "n").join(labels, "v", "left").withColumn("root", F.coalesce("root", "v"))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")
    # a row meets its own band and the one above it, and every cut of its key and band
    homes = F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("lower")), F.struct((band + 1).alias("band"), F.lit(1).alias("lower"))))
    homed = rows.select("key", "v", "n", "root", homes.alias("home")).select("key", "v", "n", "root", "home.band", "home.lower")
    # only tiles with rows of two components, one of them in its own band, get signatures
    mixed = homed.groupBy("key", "band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("lower").alias("own"), F.count("*").alias("rows")).where("r0 <> r1 AND own = 0").select("key", "band", F.ceil(F.col("rows") / tile_rows).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int")
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: F.struct(F.least(c, F.col("cut")).alias("i"), F.greatest(c, F.col("cut")).alias("j"))))
    homed = written(homed.join(mixed, ["key", "band"]), "tile-rows")
    freed(postings.sparkSession)
    placed = homed.join(vertices.select("v", "sig"), "v").withColumn("cut", cut).select("key", "v", "n", "root", "sig", "cut", "band", "lower", spread.alias("t"))
    placed = placed.select("key", "band", "t.i", "t.j", "lower", "cut", "v", "n", "root", "sig")

    def run(batches):
        held, name, forest = [], None, Forest()

        def pairs():
            lower, cut, v, n, root = (np.array([r[c] for r in held]) for c in (0, 1, 2, 3, 4))
            if spanning:
                if len(forest.up) > 1 << 20:
                    forest.up.clear()
                root = forest.of(root)
                if (root == root[0]).all():
                    return
            bits = folded([r[5] for r in held])
            some = max(256, (1 << 20) // bits.shape[1])
            own = np.flatnonzero(lower == 0)
            for at in range(0, len(own), 256):
                x = own[at : at + 256, None]
                y = np.arange(len(held))[None, :]
                fits = (root[x] != root[y]) & ((lower[y] == 1) | (v[x] < v[y])) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
                if name[2] != name[3]:
                    fits &= cut[x] != cut[y]
                i, j = np.nonzero(fits)
                for part in range(0, len(i), some):
                    p, q = own[at + i[part : part + some]], j[part : part + some]
                    if spanning:
                        apart = root[p] != root[q]
                        p, q = p[apart], q[apart]
                    ok = _allowed(n[p], n[q], np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64), percent)
                    if spanning:
                        if ok.any():
                            yield forest.new(root[p[ok]], root[q[ok]])
                            root = forest.of(root)
                        continue
                    p, q = v[p[ok]], v[q[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), pa.int64()), pa.array(np.maximum(p, q), pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols):
                if row[:4] != name:
                    if len(held) > 1:
                        yield from pairs()
                    held, name = [], row[:4]
                held.append(row[4:])
        if len(held) > 1:
            yield from pairs()

    out = placed.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j").mapInArrow(run, "a long, b long")
    return out if spanning else out.distinct()


def linked(sets: list[np.ndarray], root: np.ndarray, cut: np.ndarray, across: bool, percent: int, forest: Forest, block: int = 256):
    """Batches of edges (a, b) between roots that join what the links between the sets join; of sets of
    different cuts only, if across."""
    n = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(n)])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    # a shingle of one set alone is in no overlap
    shared = count[column] > 1
    start, row, column = np.concatenate([[0], np.cumsum(shared)])[start], row[shared], column[shared]
    place = np.full(len(count), -1)
    root = forest.of(root)
    for at in range(0, len(sets), block):
        own = np.unique(column[start[at] : start[min(at + block, len(sets))]])
        x, y = np.arange(at, min(at + block, len(sets)))[:, None], np.arange(at, len(sets))[None, :]
        fits = (x < y) & (root[x] != root[y]) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
        if across:
            fits &= cut[x] != cut[y]
        p, q = np.nonzero(fits)
        if not len(p) or not len(own):
            continue
        place[own] = np.arange(len(own))
        c, r = place[column[start[at] :]], row[start[at] :] - at
        c, r = c[c >= 0], r[c >= 0]
        bits = np.zeros((len(sets) - at, len(own) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (r, c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        place[own] = -1
        some = max(256, (1 << 20) // bits.shape[1])
        for part in range(0, len(p), some):
            i, j = p[part : part + some], q[part : part + some]
            apart = root[at + i] != root[at + j]
            i, j = i[apart], j[apart]
            both = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
            i, j = at + i, at + j
            ok = 100 * both >= percent * (n[i] + n[j] - both)
            if ok.any():
                yield forest.new(root[i[ok]], root[j[ok]])
                root = forest.of(root)


def settled(families: DataFrame, vertices: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int, most: int = 1 << 20, few: int = 500_000) -> DataFrame:
    """Edges between roots of the same family (v: root, root: its family) that join what exact links
    join. A cut of a family holds about `most` shingles, a task those of two cuts; every text moves once if one
    cut is enough. Up to `few` rows of families go to the documents, else the documents come to them."""
    spark = docs.sparkSession
    rows = vertices.select("v", "n").join(labels, "v", "left").withColumn("root", F.coalesce("root", "v")).join(families.select(F.col("v").alias("root"), F.col("root").alias("family")), "root")
    rows = written(rows.groupBy("v", "root", "family").agg(F.sum("n").alias("n")), "family-rows")
    freed(spark)
    cuts = rows.groupBy("family").agg(F.ceil(F.sum("n") / most).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int")
    placed = rows.join(cuts, "family").withColumn("cut", cut).select("v", "family", "cuts", "cut", "root")
    docs = docs.where("doc_id IS NOT NULL")
    if rows.count() <= few:
        placed = F.broadcast(placed)
    else:
        may = spark.sparkContext.broadcast(bloom_of(rows, "v"))

        def named(batches):
            for batch in batches:
                yield batch.filter(pa.array(may.value.may_have(as_long(batch.column(0)))))

        docs = docs.mapInArrow(named, docs.schema)
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: F.struct(F.least(c, F.col("cut")).alias("i"), F.greatest(c, F.col("cut")).alias("j"))))
    texts = docs.join(placed, docs["doc_id"] == placed["v"]).withColumn("t", spread).select("v", "text", "family", "t.i", "t.j", "cut", "root")

    def run(batches):
        held, name, forest = [], None, Forest()

        def links():
            _, cut, root, sets = zip(*held)
            yield from linked(sets, np.array(root), np.array(cut), name[1] != name[2], percent, forest)

        for batch in batches:
            where = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)))
            for _, sets in _sets(batch, width):
                for s, (v, *at, cut, root) in zip(sets, where):
                    if at != name:
                        if len(held) > 1:
                            yield from links()
                        # edges of a family's other tasks are not known here, those of other families don't matter
                        held, name, forest = [], at, Forest()
                    if len(s) and not (held and held[-1][0] == v and np.array_equal(held[-1][3], s)):
                        held.append((v, cut, root, s))
        if len(held) > 1:
            yield from links()

    return texts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "v").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.count()
    bits = min(24, max(18, (64 * max(rows, 1) - 1).bit_length()))
    classes = spark.sparkContext.broadcast(cell_classes(docs, bits, width))
    index = written(indexed(docs, classes, bits, width, percent), "shingle-index")
    groups = index.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    freed(spark)
    copies = written(groups.where("rep <> last").select("digest", "n", "rep"), "copies")
    # of equal sets only the smallest doc_id is indexed
    others = written(index.join(copies, ["digest", "n"]).where("doc_id <> rep").select("doc_id", "rep"), "copied")
    few = others.count() <= 1_000_000
    vertices = index.where("n > 0 AND doc_id IS NOT NULL").join(F.broadcast(others) if few else others, "doc_id", "left_anti").withColumnRenamed("doc_id", "v")
    postings = written(shared_keys(vertices.select(F.explode("keys").alias("key"), "v", "n"), percent), "postings")
    freed(spark)
    stars = postings.where("leader <> v").select(F.col("leader").alias("a"), F.col("v").alias("b")).distinct()
    links = written(verified(bounded(stars, vertices, percent), docs, width, percent), "star-links")
    labels = written(components(links), "star-labels")
    families = written(components(tiles(postings, vertices, labels, percent, spanning=True)), "families")
    more = written(settled(families, vertices, labels, docs, width, percent), "root-links")
    if not more.isEmpty():
        # links across components join their roots; members follow
        over = written(components(more), "root-labels").withColumnRenamed("v", "r").withColumnRenamed("root", "top")
        members = labels.join(over, labels["root"] == over["r"], "left").select("v", F.coalesce("top", "root").alias("root"))
        alone = over.join(labels, over["r"] == labels["v"], "left_anti").select(F.col("r").alias("v"), F.col("top").alias("root"))
        labels = written(members.unionByName(alone), "labels")
    where = index.select("doc_id", "n").join(F.broadcast(others) if few else others, "doc_id", "left").withColumn("v", F.coalesce("rep", "doc_id"))
    drop(postings)
    return where.join(labels, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "v").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; null ids stay. Rows
    that share a doc_id are one document and stay or go together."""
    gone = written(near_groups(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= 1_000_000
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))

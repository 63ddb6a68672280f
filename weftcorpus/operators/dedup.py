"""Near-duplicate removal by MinHash bands, keeping the first row of a collision.

A row goes if it shares a band with an earlier row that stays; rows that went
count no more. That is the lexicographically first independent set of the
collision graph. It is found in rounds over (row, band) memberships, never over
pairs. A round deals the open rows to ranges of bounded size; each range goes
through its rows in order and decides all that don't hang on an open row of an
earlier range, then rows that share a band with one that stays go, whatever their
range. So a chain of rows takes as many rounds as it crosses ranges, not as it has
links, and a band of a third of all rows is settled by its first row at once.
With verify=True similar rows that share a band are found first, once for all rounds:
a bucket is cut into tiles of bounded size, whose n-gram sets are multiplied as 0-1
matrices. Rounds then go over pairs of similar rows, as if each were a bucket. Of rows
with the same n-grams and buckets only the first takes part: whatever makes it go or
stay, the others go. Rows like one that is the first in all its buckets go before, so
that large groups of near copies make few pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcorpus.functions import text as T
from weftcorpus.sources.shared import drop, shared_dir, written

_EMPTY = (1 << 32) - 1


def optimal_bands(threshold: float, num_perm: int, steps: int = 400) -> tuple[int, int]:
    """(bands, rows): equal weight for the areas of false positives and negatives of the collision curve."""
    x = (np.arange(steps) + 0.5) / steps
    best = None
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            p = 1 - (1 - x**r) ** b
            cost = (p[x < threshold].sum() + (1 - p[x >= threshold]).sum()) / steps
            if best is None or cost < best[0] - 1e-12:
                best = (cost, b, r)
    return best[1], best[2]


def grams(text: str, n: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a stripped text; a shorter text is its own n-gram."""
    x = np.frombuffer(text.strip().encode("utf-32-le"), np.uint32).astype(np.uint64)
    width = min(n, len(x)) or 1
    h = np.zeros(max(len(x) - width + 1, 0), np.uint64)
    for i in range(width):
        h = (h ^ x[i : i + len(h)]) * np.uint64(MinHashDeduplicator.GRAM)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each permutation a * h + b, 32 bits."""
    out = np.full(len(a), _EMPTY << 32, np.uint64)
    for at in range(0, len(h), 512):
        part = h[at : at + 512, None] * a
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _in_order(batches):
    """The memberships of the rows of a range, in order, that certainly stay. batches: row, bucket, first (the bucket's
    earliest open row, of whatever range), sorted by row."""
    start, at, own, open_before = None, None, [], False
    kept, waiting, out = set(), set(), []

    def close():
        # a row goes with a bucket of one that stays; it waits with a bucket of one that waits
        if not kept.isdisjoint(own):
            return
        if open_before or not waiting.isdisjoint(own):
            waiting.update(own)
        else:
            kept.update(own)
            out.extend((at, b) for b in own)

    for batch in batches:
        for row, bucket, first in zip(*(c.to_pylist() for c in batch.columns)):
            if row != at:
                if own:
                    close()
                start = row if start is None else start
                at, own, open_before = row, [], False
            own.append(bucket)
            open_before = open_before or first < start
    if own:
        close()
    for i in range(0, max(len(out), 1), 50_000):
        rows, buckets = zip(*out[i : i + 50_000]) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(buckets, pa.int64())], ["row", "bucket"])


def exact_grams(text: str, n: int) -> np.ndarray:
    """The distinct n-grams of a stripped text as sorted numbers: the code points themselves for n up to 3, hashes beyond."""
    x = np.frombuffer(text.strip().encode("utf-32-le"), np.uint32).astype(np.uint64)
    if n > 3 or not len(x):
        return grams(text, n)
    width = min(n, len(x))
    out = np.zeros(len(x) - width + 1, np.uint64)
    for i in range(width):
        out = (out << np.uint64(21)) | (x[i : i + len(out)] + np.uint64(1))
    return np.unique(out)


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of threshold or more."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= threshold * (len(x) + len(y) - common)


def packed(h: np.ndarray) -> bytes:
    """A sorted set as the bytes of its steps, all lowest bytes first: n-grams lie close, so most bytes are zero and compress."""
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(s) -> np.ndarray:
    return np.cumsum(np.frombuffer(s, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many elements each set of left has in common with each of right, by products of 0-1 matrices of so many columns."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    # only elements of several sets count
    row, column = row[again], np.cumsum(new[again]) - 1
    out = np.zeros((len(left), len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        x, y = np.searchsorted(column, (at, at + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[row[x:y], column[x:y] - at] = 1
        out += m[left] @ m[right].T
    return out


def _alike(rows: list[int], parts: list[int], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a tile, later and earlier one, that are similar: of its two parts, or within the only one."""
    row, part = np.array(rows), np.array(parts)
    left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    n = np.array([len(x) for x in sets])
    if len(rows) < 5:
        ok = np.array([[similar(sets[i], sets[j], threshold) for j in right] for i in left])
    else:
        common = common_counts(sets, left, right)
        ok = common >= threshold * (n[left][:, None] + n[right] - common)
    x, y = (side[i] for side, i in zip((left, right), np.nonzero(ok)))
    x, y = row[x], row[y]
    later, earlier = np.maximum(x, y), np.minimum(x, y)
    return later[later > earlier], earlier[later > earlier]


def _tiles(batches, threshold: float):
    """(row, other) of similar rows, other < row. batches: bucket, i, j, part, row, s, sorted by tile (bucket, i, j)."""
    tile, rows, parts, sets = None, [], [], []

    def close():
        # a tile of two parts may have lost one of them
        if len(rows) > 1 and (tile[1] == tile[2] or len(set(parts)) > 1):
            later, earlier = _alike(rows, parts, sets, threshold)
            for i in range(0, len(later), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(later[i : i + 50_000], pa.int64()), pa.array(earlier[i : i + 50_000], pa.int64())], ["row", "other"])

    for batch in batches:
        for bucket, i, j, part, row, s in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, i, j) != tile:
                yield from close()
                tile, rows, parts, sets = (bucket, i, j), [], [], []
            rows.append(row)
            parts.append(part)
            sets.append(unpacked(s))
    yield from close()


@dataclass(frozen=True)
class MinHashDeduplicator:
    num_perm: int = 128
    threshold: float = 0.85
    ngram_size: int = 3
    text_field: str = "text"
    id_field: str = "row_id"
    prompt_field: str = "prompt"
    response_field: str = "response"
    verify: bool = False
    seed: int = 1
    #: So many open memberships go through one task of a round, in order.
    range_rows: int = 100_000
    #: With verify, about so many bytes of n-gram sets are compared at once, and so many rows.
    range_bytes: int = 32 << 20
    tile_rows: int = 1024

    MIX = 0xD6E8FEB86659FD93
    GRAM = 0x9E3779B97F4A7C15

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        """Factors (odd) and summands of the permutations of 64-bit hashes."""
        rng = np.random.default_rng(self.seed)
        a = rng.integers(1, 1 << 63, self.num_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, rng.integers(0, 1 << 63, self.num_perm, dtype=np.uint64)

    def text(self, df: DataFrame) -> Column:
        """The text, or prompt and response where it is empty or missing."""
        own = T.text(self.text_field) if self.text_field in df.columns else F.lit("")
        qa = [T.text(c) if c in df.columns else F.lit("") for c in (self.prompt_field, self.response_field)]
        return F.when(own != "", own).otherwise(T.strip(F.concat(qa[0], F.lit(" "), qa[1])))

    def bands(self, df: DataFrame) -> DataFrame:
        """(row, band, hash) of every row with text."""
        b, r = optimal_bands(self.threshold, self.num_perm)
        a, c = (x[: b * r] for x in self.permutations())
        n, mix = self.ngram_size, self.MIX

        def run(batches):
            powers = np.multiply.accumulate(np.full(r, mix, np.uint64))
            for batch in batches:
                rows, hashes = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = signature(grams(t, n), a, c).reshape(b, r).astype(np.uint64)
                    rows.append(i)
                    hashes.append((((s + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64)).view(np.int64))
                flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, b), pa.int64()), pa.array(np.tile(np.arange(b), len(rows)), pa.int32()), pa.array(flat, pa.int64())], ["row", "band", "hash"])

        own = df.select(F.col(self.id_field).cast("long").alias("row"), self.text(df).alias("t")).where("t <> '' AND row IS NOT NULL")
        return own.mapInArrow(run, "row long, band int, hash long")

    def dropped(self, df: DataFrame) -> DataFrame:
        """row: the rows with text that go."""
        spark = df.sparkSession
        shared_dir(spark)
        every = written(self.bands(df), "every")
        shared = every.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash")
        open_ = written(every.join(shared, ["band", "hash"]).select(F.xxhash64("band", "hash").alias("bucket"), "row"), "bands")
        drop(every)
        gone = []
        if self.verify:
            open_, same = self._verified(df, open_)
            gone.extend(same)
        while n := open_.count():
            first = open_.groupBy("bucket").agg(F.min("row").alias("first"))
            ranges = open_.join(first, "bucket").select("row", "bucket", "first").repartitionByRange(-(-n // self.range_rows), "row").sortWithinPartitions("row")
            kept = written(ranges.mapInArrow(_in_order, "row long, bucket long"), "kept")
            behind = open_.join(kept.select("bucket", F.col("row").alias("kept")), "bucket").where("row > kept")
            goes = written(behind.select("row").distinct(), "goes")
            rest = open_.join(goes, "row", "left_anti").join(kept.select("row").distinct(), "row", "left_anti")
            after = written(rest.select("bucket", "row"), "bands")
            drop(open_, kept)
            gone.append(goes)
            open_ = after
        out = spark.createDataFrame([], "row long")
        for g in gone:
            out = out.unionByName(g)
        return out.distinct()

    def _verified(self, df: DataFrame, members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(bucket, row) with a bucket for each pair of similar rows that share a bucket of members; and tables of the rows
        that go beforehand, as an earlier row has the same n-grams and buckets or one like them certainly stays. Deletes members."""
        sets = written(self._sets(df, members), "sets")
        own = members.groupBy("row").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
        own = own.join(sets.groupBy("row").agg(F.sort_array(F.collect_set("digest")).alias("grams"), F.sum("size").alias("size")), "row")
        heads = written(own.groupBy("buckets", "grams").agg(F.min("row").alias("row"), F.max("size").alias("size"), F.collect_list("row").alias("rows")), "heads")
        same = written(heads.select(F.explode("rows").alias("same"), "row").where("same > row").select(F.col("same").alias("row")), "same")
        at = written(heads.select("row", "size", F.explode("buckets").alias("bucket")), "at")
        gone = [same]
        while True:
            # a row that is first in all its buckets stays; rows like it go before all pairs are compared
            first = at.groupBy("bucket").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
            shared = at.join(first, "bucket")
            stays = shared.groupBy("row").agg(F.min("first").alias("first")).where("first = row").select("first")
            star = shared.where("row > first").join(stays, "first").select("first", "row", "size").distinct()
            cuts = star.groupBy("first").agg(F.greatest(F.ceil(F.count("*") / self.tile_rows), F.ceil(F.sum("size") / self.range_bytes)).cast("long").alias("cuts"))
            tips = star.join(cuts, "first").selectExpr("first AS bucket", "0L AS i", "1 + pmod(xxhash64(row, first), cuts) AS j", "row", "size")
            centres = tips.select("bucket", "i", "j").distinct().join(heads.select(F.col("row").alias("bucket"), "size"), "bucket")
            near = self._similar(tips.selectExpr("bucket", "i", "j", "j AS part", "row", "size").unionByName(centres.selectExpr("bucket", "i", "j", "i AS part", "bucket AS row", "size")), sets)
            goes = written(near.select("row").distinct(), "gone")
            rest = written(shared.join(goes, "row", "left_anti").join(stays.withColumnRenamed("first", "row"), "row", "left_anti").select("row", "size", "bucket"), "at")
            drop(at, near)
            at = rest
            gone.append(goes)
            if 10 * goes.count() <= at.select("row").distinct().count():
                break
        # a bucket is cut into parts at random; each pair of parts is a tile
        cuts = at.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
        whole = (F.col("n") <= self.tile_rows) & (F.col("bytes") <= self.range_bytes)
        cuts = cuts.select("bucket", F.when(whole, 1).otherwise(F.greatest(F.ceil(2 * F.col("n") / self.tile_rows), F.ceil(2 * F.col("bytes") / self.range_bytes))).cast("long").alias("cuts"))
        parts = at.join(cuts, "bucket").select("bucket", "row", "size", "cuts", F.expr("pmod(xxhash64(row, bucket), cuts)").alias("part"))
        tiles = parts.select("bucket", "row", "size", "part", F.explode(F.expr("sequence(0L, cuts - 1)")).alias("with"))
        pairs = self._similar(tiles.selectExpr("bucket", "least(part, with) AS i", "greatest(part, with) AS j", "part", "row", "size"), sets)
        out = written(pairs.select(F.xxhash64("row", "other").alias("bucket"), F.explode(F.array("row", "other")).alias("row")), "bands")
        drop(members, sets, heads, at, pairs)
        return out, gone

    def _similar(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(row, other): similar rows of a tile (bucket, i, j, part, row, size), of its two parts or within the only one."""
        tiles = written(members, "tiles")
        n, size = tiles.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        dealt = tiles.drop("size").join(sets.select("row", "s"), "row").select("bucket", "i", "j", "part", "row", "s")
        dealt = dealt.repartition(max(1, -(-n // self.range_rows), -(-size // self.range_bytes)), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        threshold = self.threshold
        pairs = written(dealt.mapInArrow(lambda batches: _tiles(batches, threshold), "row long, other long").distinct(), "pairs")
        drop(tiles)
        return pairs

    def _sets(self, df: DataFrame, members: DataFrame) -> DataFrame:
        """(row, s, size, digest): the n-grams of each row of members, packed, how many bytes they take and their digest."""
        n = self.ngram_size

        def run(batches):
            for batch in batches:
                s = [packed(exact_grams(t, n)) for t in batch.column(1).to_pylist()]
                digests = [hashlib.md5(x, usedforsecurity=False).digest() for x in s]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary()), pa.array([len(x) for x in s], pa.int64()), pa.array(digests, pa.binary())], ["row", "s", "size", "digest"])

        own = df.select(F.col(self.id_field).cast("long").alias("row"), self.text(df).alias("t")).where("t <> '' AND row IS NOT NULL")
        return own.join(members.select("row").distinct(), "row", "left_semi").mapInArrow(run, "row long, s binary, size long, digest binary")

    def dedup(self, df: DataFrame) -> DataFrame:
        """df without the rows that go; rows without text go too."""
        out = df.where(self.text(df) != "")
        gone = self.dropped(df).withColumnRenamed("row", "_gone")
        return out.join(gone, F.col(self.id_field) == F.col("_gone"), "left_anti")

    def stats(self, df: DataFrame, kept: DataFrame) -> DataFrame:
        """One row: original_count, deduplicated_count, removed_count, dedup_ratio."""
        both = df.agg(F.count("*").alias("original_count")).crossJoin(kept.agg(F.count("*").alias("deduplicated_count")))
        removed = F.col("original_count") - F.col("deduplicated_count")
        return both.withColumns({"removed_count": removed, "dedup_ratio": T.safe_ratio(removed, F.col("original_count"))})

"""Approximate nearest neighbours by additive quantisation.

A vector's direction is the sum of one word from each of several full-dimensional
codebooks, trained one after another on what the earlier ones leave; a beam
search picks the words. The index keeps codes, the vector's norm and that of its
reconstruction. A query scores rows by sums of looked-up inner products, scaled
by the stored norms; those that are among its best so far in a part of the index are
ranked again by the exact inner product in double precision, and parts are merged.

Copies of a vector are one index entry with its smallest ids, so that they can't
crowd a shortlist. Queries go in groups of bounded size over all blocks of the index.

Edge cases: vectors that are null, zero, of another length than most, or with
null or non-finite components take no part; a null id neither; ties go to the
smaller id, but of looked-up scores that are equal at the end of a shortlist any may enter
it; vectors of any length are compared whole; repeated rows are one entry; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import table, trim, written

#: A row for each block of entries: their ids, vectors, codes and scales side by side.
INDEX = "ids array<array<long>>, vectors binary, codes binary, scales binary"


def residual_codebooks(x: np.ndarray, books: int, words: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """(books, words, dim): each codebook is k-means on the residuals of the ones before."""
    rng = np.random.default_rng(seed)
    left, out = x.copy(), []
    for _ in range(books):
        k = min(words, len(left))
        c = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)
            n = np.bincount(near, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, near, left)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], left[rng.integers(len(left), size=k)])
        near = np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)
        left = left - c[near]
        out.append(np.concatenate([c, np.zeros((words - k, x.shape[1]))]) if k < words else c)
    return np.array(out)


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """The codes (n, books) of the best sum that a beam search over the codebooks finds."""
    n, words = len(x), books.shape[1]
    left = x[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        norms = (book * book).sum(1)
        cost = (left * left).sum(2)[:, :, None] - 2 * left @ book.T + norms
        width = min(beam, cost.shape[1] * words)
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
        parent, word = best // words, best % words
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        left = left[rows, parent] - book[word]
    best = np.argmin((left * left).sum(2), axis=1)
    return codes[np.arange(n), best]


def usable(rows: DataFrame) -> DataFrame:
    """id and vector (doubles as bytes) of the rows that take part."""
    size = rows.where("id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = size.n if size else 0

    def run(batches):
        for batch in batches:
            keep, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(v) == n and n and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        keep.append(i)
                        out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["id", "vector"])

    return rows.where("id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, "id long, vector binary")


def train(vectors: DataFrame, books: int, words: int, sample: int) -> np.ndarray | None:
    """Codebooks from at most `sample` directions, the first by hash of their id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(r.vector for r in rows), np.float64).reshape(len(rows), -1)
    return residual_codebooks(x / np.linalg.norm(x, axis=1, keepdims=True), books, words)


def build(vectors: DataFrame, codebooks: np.ndarray, k: int, beam: int, block: int = 2048) -> DataFrame:
    """The index: blocks of distinct vectors, each with its k + 1 smallest ids."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    distinct = vectors.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # the other ids of copies; only k + 1 of them can ever be among the k nearest
    some = distinct.where("n > 1").select("vector")
    copies = (
        vectors.join(some, "vector", "left_semi")
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .groupBy("vector", "salt")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .select("vector", F.slice("ids", 1, k + 1).alias("ids"))
        .groupBy("vector")
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    )
    rows = distinct.join(copies, "vector", "left").select(F.coalesce("ids", F.array("id")).alias("ids"), "vector")

    def run(batches):
        c = shared.value
        held, size = [], 0

        def packed(parts):
            ids, raw = sum((p.column("ids").to_pylist() for p in parts), []), b"".join(v for p in parts for v in p.column("vector").to_pylist())
            x = np.frombuffer(raw, np.float64).reshape(len(ids), -1)
            norm = np.linalg.norm(x, axis=1)
            codes = np.concatenate([beam_encode(x[i : i + 256] / norm[i : i + 256, None], c, beam) for i in range(0, len(x), 256)])
            found = sum(c[m][codes[:, m]] for m in range(len(c)))
            scale = norm / np.maximum(np.linalg.norm(found, axis=1), 1e-12)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.list_(pa.int64()))), *[pa.array([x], pa.binary()) for x in (raw, codes.tobytes(), scale.tobytes())]], ["ids", "vectors", "codes", "scales"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == block:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)
        trim()

    return written(rows.mapInArrow(run, INDEX), "ann-index")


def nearest_in(query_ids, q, ids, x, codes, scale, tables, best, k, shortlist):
    """For each query the exact best k of a block's entries that are among the best `shortlist` so far by
    looked-up scores, as (-score, id). best: those scores of each query, which this block's are added to."""
    out = []
    for at in range(0, len(q), 64):
        approx = np.zeros((min(64, len(q) - at), len(x)), np.float32)
        for m in range(len(tables)):
            approx += tables[m, at : at + 64][:, codes[:, m]]
        approx *= scale
        short = np.argpartition(-approx, shortlist - 1, axis=1)[:, :shortlist] if shortlist < len(x) else np.tile(np.arange(len(x)), (len(approx), 1))
        looked = np.take_along_axis(approx, short, axis=1)
        enter = looked >= best[at : at + 64].min(axis=1, keepdims=True)
        best[at : at + 64] = -np.partition(-np.concatenate([best[at : at + 64], looked], axis=1), shortlist - 1, axis=1)[:, :shortlist]
        for i, (near, ok) in enumerate(zip(short, enter)):
            near = near[ok]
            # added up from left to right, so that a score doesn't hang on the order of a block
            exact = np.add.accumulate(x[near] * q[at + i], axis=1)[:, -1]
            cut = np.argsort(-exact, kind="stable")[: 4 * k + 4]
            last = exact[cut[min(k, len(cut) - 1)]] if len(cut) else 0.0
            out.append(sorted((-float(s), j) for s, r in zip(exact, near) if s >= last for j in ids[r] if j != query_ids[at + i])[:k])
    return out


def search(index: DataFrame, queries: DataFrame, codebooks: np.ndarray, k: int, shortlist: int, group: int = 1024, part_blocks: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score. Groups of queries are rows of a table, and so are blocks of the index; each task
    takes some groups past one part of the index and answers with k results a query. Neither ever reaches the driver."""
    spark = index.sparkSession
    books = spark.sparkContext.broadcast(codebooks)
    groups = max(1, -(-queries.count() // group))
    asked = queries.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("id", "vector")).alias("q")).select("g", F.col("q.id").alias("query_ids"), F.col("q.vector").alias("q"))
    asked = written(asked.repartition(min(groups, 4096), "g"), "ann-queries")
    # few parts of the index, so that there are few answers to merge; but no more blocks in one than a task can buffer
    blocks = index.count()
    parts = max(-(-blocks // part_blocks), min(blocks, -(-4 * spark.sparkContext.defaultParallelism // groups)), 1)
    pairs = asked.hint("shuffle_replicate_nl").crossJoin(index.repartition(parts))

    def run(batches):
        own, held = None, []

        def answers():
            query_ids = own[1]
            return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array([[-s for s, _ in m] for m in held], pa.list_(pa.float64())), pa.array([[j for _, j in m] for m in held], pa.list_(pa.int64()))], ["query_id", "scores", "ids"])

        for batch in batches:
            for g, query_ids, q, ids, vectors, codes, scales in zip(*(batch.column(i) for i in range(7))):
                if own is None or own[0] != g.as_py():
                    if held:
                        yield answers()
                    q = np.frombuffer(b"".join(q.as_py()), np.float64).reshape(len(q), -1)
                    own = g.as_py(), query_ids.as_py(), q, np.einsum("qd,mwd->mqw", q, books.value).astype(np.float32), np.full((len(q), shortlist), -np.inf, np.float32)
                    held = [[] for _ in q]
                ids = ids.as_py()
                x = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(ids), -1)
                codes = np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(ids), -1)
                for mine, found in zip(held, nearest_in(own[1], own[2], ids, x, codes, np.frombuffer(scales.as_buffer(), np.float64).astype(np.float32), own[3], own[4], k, shortlist)):
                    mine += found
                    mine.sort()
                    del mine[k:]
        if held:
            yield answers()
        trim()

    found = pairs.select("g", "query_ids", "q", "ids", "vectors", "codes", "scales").mapInArrow(run, "query_id long, scores array<double>, ids array<long>")

    def merge(batches):
        held, name = [], None

        def best():
            top = sorted({(-s, j) for row in held for s, j in zip(*row)})[:k]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(top), pa.int64()), pa.array(range(1, len(top) + 1), pa.int32()), pa.array([j for _, j in top], pa.int64()), pa.array([-s for s, _ in top], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, s, i in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if q != name:
                    if held:
                        yield best()
                    held, name = [], q
                held.append((s, i))
                if len(held) >= 64:  # bounded, however many blocks answer
                    top = sorted({(-s, j) for row in held for s, j in zip(*row)})[:k]
                    held = [([-s for s, _ in top], [j for _, j in top])]
        if held:
            yield best()

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def neighbours(rows: DataFrame, k: int = 20, every: int = 20, books: int = 8, words: int = 256, beam: int = 4, shortlist: int = 800, sample: int = 8192) -> DataFrame:
    """rows (id, embedding): the k nearest of every row whose id is divisible by `every`."""
    vectors = written(usable(rows.select(F.col("id").cast("long").alias("id"), "embedding")), "vectors")
    codebooks = train(vectors, books, words, sample)
    if codebooks is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(vectors, codebooks, k, beam)
    return search(index, vectors.where(F.col("id") % every == 0), codebooks, k, shortlist)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
